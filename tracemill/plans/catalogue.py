"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import evals as E
from tracemill.operators import motifs as M
from tracemill.operators import pairs as P
from tracemill.operators import prefixes as N
from tracemill.operators import quality as Q
from tracemill.operators import rir as R
from tracemill.operators import select as B
from tracemill.operators import stats as X
from tracemill.operators import traces as T
from tracemill.plans import sqltext as S
from tracemill.session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(S.RECURSIVE + " select * from ann")
def trace_annotation(spark, d):
    """Metrics of every trace."""
    return T.annotate(T.parsed(spark, d))


@query(S.PLAIN + " select problem_id, rollout_id, trace_id, step_id, step_type, char_length from s")
def step_types(spark, d):
    p = T.traces(spark, d).withColumn("steps", T.step_array(F.col("solution")))
    rows = F.transform("steps", lambda s: F.struct(s["id"].alias("step_id"), s["step_type"].alias("step_type"), s["char_length"].alias("char_length")))
    return T.unique(p.select(*T.KEYS, rows.alias("rows"))).select(*T.KEYS, F.explode("rows").alias("s")).select(*T.KEYS, "s.*")


@query(S.PLAIN + " select problem_id, rollout_id, trace_id, step_id, array_to_string(sym, ' ') as symbols from s")
def step_symbols(spark, d):
    p = T.traces(spark, d).withColumn("steps", T.step_array(F.col("solution")))
    rows = F.transform("steps", lambda s: F.struct(s["id"].alias("step_id"), F.array_join(s["sym"], " ").alias("symbols")))
    return T.unique(p.select(*T.KEYS, rows.alias("rows"))).select(*T.KEYS, F.explode("rows").alias("s")).select(*T.KEYS, "s.*")


@query(S.RECURSIVE + " select problem_id, rollout_id, trace_id, src, dst from e")
def dag_edges(spark, d):
    x = T.exploded(T.parsed(spark, d))
    return x.select(*T.KEYS, F.explode("inputs").alias("src"), F.col("step_id").alias("dst"))


@query(S.RECURSIVE + " select problem_id, rollout_id, trace_id, step_id, is_live from ls")
def live_dead_steps(spark, d):
    return T.exploded(T.parsed(spark, d)).select(*T.KEYS, "step_id", "is_live")


@query(S.RECURSIVE + " select problem_id, rollout_id, trace_id, step_type, count(*) as total, count(*) filter (not is_live) as dead, count(*) filter (not is_live)::double / count(*) as ratio from ls group by all")
def typed_dsr(spark, d):
    return T.typed_dsr(T.parsed(spark, d))


# Motifs, dead-step quality, pairs.


def _m(sql: str) -> str:
    return "with recursive " + S.MOTIFS + " " + sql


def _q(sql: str) -> str:
    return "with recursive " + S.QUALITY + " " + sql


@query(_m("select problem_id, rollout_id, trace_id, motif_seq, motif_type, first_id, length, severity, first_id - 1 as context_before_id, case when first_id + length < num_steps then first_id + length else -1 end as context_after_id from mo join agg using (rollout_id, trace_id)"))
def motifs_all(spark, d):
    return M.motifs(T.parsed(spark, d))


def _motifs_of(kind: str):
    def f(spark, d):
        return M.motifs(T.parsed(spark, d)).filter(F.col("motif_type") == kind).select(*T.KEYS, "first_id", "length", "severity")

    return f


for _name, _kind in (("dead_cascades", "dead_cascade"), ("verification_theater", "verification_theater"), ("abandoned_branches", "abandoned_branch"), ("circular_revisits", "circular_revisit")):
    QUERIES[_name] = _motifs_of(_kind)
    ORACLE[_name] = _m(f"select problem_id, rollout_id, trace_id, first_id, length, severity from mo where motif_type = '{_kind}'")


@query(_m("select t.problem_id, t.rollout_id, t.trace_id, count(motif_type) as num_motifs, coalesce(sum(length), 0)::int as wasted_steps, case when count(motif_type) > 0 then round(sum(severity) / count(motif_type), 6) else 0.0 end as mean_severity, " + ", ".join(f"count(*) filter (motif_type = '{k}') as {k}" for k in M.TYPES) + " from t left join mo using (rollout_id, trace_id) group by all"))
def motif_summary(spark, d):
    return M.motif_summary(T.parsed(spark, d))


@query(_q("select *, case quality " + " ".join(f"when '{k}' then {v}::double" for k, v in fixed.PENALTY.items()) + " end as penalty from qd"))
def dead_step_quality(spark, d):
    return Q.dead_steps(T.parsed(spark, d))


@query(_q("select problem_id, rollout_id, trace_id, quality_reward, " + ", ".join(fixed.PENALTY) + " from qr"))
def quality_reward(spark, d):
    return Q.rewards(T.parsed(spark, d))


def scored(spark, d):
    """Every trace with its metrics, reward and answer features, in one narrow pass."""
    p = T.parsed(spark, d)
    w = Q.with_quality(p)
    n = F.size("steps")
    dead = n - F.size("live")
    verif = F.filter("steps", lambda s: s["step_type"] == "verification")
    kinds = {k: Q.count_of(k) for k in fixed.PENALTY}
    cost = sum((c * F.lit(fixed.PENALTY[k]) for k, c in kinds.items()), F.lit(0.0))
    live_v = F.size(F.filter(verif, lambda s: F.array_contains("live", s["id"])))
    at = text.answer_position(F.col("solution"))
    rows = w.select(
        *T.KEYS,
        "shard",
        "is_correct",
        "num_tokens",
        "answer",
        "ground_truth",
        n.cast("bigint").alias("num_steps"),
        dead.cast("bigint").alias("num_dead"),
        F.when(n > 0, dead / n).otherwise(0.0).alias("dsr"),
        F.when(n > 0, F.size(verif) / n).otherwise(0.0).alias("verification_density"),
        F.when(n == 0, 0.0).when(F.size(verif) > 0, live_v / F.size(verif)).otherwise(1.0).alias("live_verification_rate"),
        F.round(F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cost / n))).otherwise(1.0), 9).alias("quality_reward"),
        F.when(at < 1.0, F.length("solution") * (1.0 - at)).otherwise(0.0).alias("post_answer_len"),
        *[c.cast("bigint").alias(k) for k, c in kinds.items()],
    )
    return T.unique(rows)


def _outcomes(spark, d):
    """What is known of every trace without its text."""
    return T.unique(T.traces(spark, d).select(*T.KEYS, "shard", "is_correct", "num_tokens"))


def _annotated(spark, d):
    return T.annotate(T.parsed(spark, d))


def _prepared(spark, d):
    return P.prepare(T.parsed(spark, d))


@query(S.RECURSIVE + " " + S.EFFICIENCY)
def efficiency_pairs(spark, d):
    return P.efficiency_pairs(_prepared(spark, d))


@query(S.RECURSIVE + " " + S.PRODUCTIVE)
def productive_pairs(spark, d):
    return P.productive_pairs(_prepared(spark, d))


@query(S.RECURSIVE + " " + S.DIRECTION)
def direction_pairs(spark, d):
    return P.direction_pairs(_prepared(spark, d))


@query(_m(S.EXCISION))
def excision_pairs(spark, d):
    return P.excision_texts(T.parse(T.single(spark, d)))


@query("with recursive " + S.FLAGS + " " + S.REPLACEMENT)
def replacement_pairs(spark, d):
    return P.replacement_pairs(_prepared(spark, d))


@query("with recursive " + S.FLAGS + " " + S.CONTRAST)
def contrast_pairs(spark, d):
    return P.contrast_pairs(_prepared(spark, d))


@query("with recursive " + S.FLAGS + " " + S.ALL_PAIRS)
def all_pairs(spark, d):
    return P.all_pairs(_prepared(spark, d))


@query(_q("select quality, count(*) as n, round(count(*)::double / (select count(*) from ls), 6) as share_of_steps from qd group by quality"))
def quality_distribution(spark, d):
    s = scored(spark, d)
    total = s.agg(F.sum("num_steps").alias("all_steps"), *[F.sum(k).alias(k) for k in fixed.PENALTY])
    rows = total.select("all_steps", F.explode(F.array(*[F.struct(F.lit(k).alias("quality"), F.col(k).alias("n")) for k in fixed.PENALTY])).alias("r"))
    return rows.filter("r.n > 0").select("r.quality", "r.n", F.round(F.col("r.n") / F.col("all_steps"), 6).alias("share_of_steps"))


@query(_q("select round(avg(verification_theater::double / num_steps), 6) as mean_theater, round(max(verification_theater::double / num_steps), 6) as max_theater, round(avg((verification_theater > 0)::int), 6) as share_theater, round(avg(productive_dead_end::double / num_steps), 6) as mean_productive, round(avg((productive_dead_end > 0)::int), 6) as share_productive from qr where num_steps > 0"))
def theater_prevalence(spark, d):
    s = scored(spark, d).filter("num_steps > 0")
    share = lambda k: F.col(k) / F.col("num_steps")
    some = lambda k: F.round(F.avg((F.col(k) > 0).cast("double")), 6)
    return s.agg(F.round(F.avg(share("verification_theater")), 6).alias("mean_theater"), F.round(F.max(share("verification_theater")), 6).alias("max_theater"), some("verification_theater").alias("share_theater"), F.round(F.avg(share("productive_dead_end")), 6).alias("mean_productive"), some("productive_dead_end").alias("share_productive"))


# Best of N.

_BEST = {"shortest": "is_correct desc, num_tokens", "longest": "is_correct desc, num_tokens desc", "anchor": "is_correct desc, post_answer_len", "dsr": "is_correct desc, dsr", "quality": "is_correct desc, quality_reward desc", "quality_any": "quality_reward desc"}


def _best_of(selector: str):
    def f(spark, d):
        return B.best_of_n(scored(spark, d), selector).select("problem_id", "rollout_id", "trace_id", "is_correct")

    return f


def _best_sql(order: str) -> str:
    return f"(select *, row_number() over (partition by problem_id order by {order}, rollout_id, trace_id) as k from qr)"


for _name, _order in _BEST.items():
    QUERIES[f"best_of_n_{_name}"] = _best_of(_name)
    ORACLE[f"best_of_n_{_name}"] = _q(f"select problem_id, rollout_id, trace_id, is_correct from {_best_sql(_order)} where k = 1")

_AVERAGES = "count(*) as problems, round(avg(is_correct::int::double), 6) as accuracy, round(avg(num_tokens), 6) as avg_tokens, round(avg(dsr), 6) as avg_dsr, round(avg(quality_reward), 6) as avg_quality, round(avg(num_steps), 6) as avg_steps"


@query(_q(" union all ".join(f"select '{n}' as selector, {_AVERAGES} from {_best_sql(o)} where k = 1" for n, o in _BEST.items()) + f" union all select 'random', {_AVERAGES.replace('is_correct::int::double', 'is_correct')} from (select problem_id, avg(is_correct::int::double) as is_correct, avg(num_tokens) as num_tokens, avg(dsr) as dsr, avg(quality_reward) as quality_reward, avg(num_steps) as num_steps from qr group by 1)"))
def best_of_n_table(spark, d):
    return B.table_of_selectors(materialize(scored(spark, d)))


@query(S.ROWS + " select count(*) as problems, sum(n) as traces, round(avg((c > 0)::int), 6) as pass_at_k, round(sum(c)::double / sum(n), 6) as accuracy from (select problem_id, count(*) as n, count(*) filter (is_correct) as c from t group by 1)")
def pass_at_k(spark, d):
    g = _outcomes(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"))
    return g.agg(F.count("*").alias("problems"), F.sum("n").alias("traces"), F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("pass_at_k"), F.round(F.sum("c") / F.sum("n"), 6).alias("accuracy"))


# Groups of problems.

_CAT = "(select problem_id, count(*) as n, count(*) filter (is_correct) as n_correct from {0} group by 1)"


@query(S.ROWS + " select problem_id, n, n_correct, case when n_correct = n then 'saturated' when n_correct > 0 then 'partial' else 'all_incorrect' end as category from " + _CAT.format("t"))
def problem_categories(spark, d):
    return X.categories(_outcomes(spark, d))


_VAR = """(select problem_id, count(*) as n, count(*) filter (is_correct) as n_correct, var_pop(is_correct::int::double) as outcome_var, var_pop(case when is_correct then 1 - dsr end) as struct_var,
   max(case when is_correct then dsr end) - min(case when is_correct then dsr end) as dsr_range, var_pop(case when is_correct then live_verification_rate end) as lvr_var from ann group by 1 having count(*) filter (is_correct) >= 2)"""
_VARS = "select case when n_correct = n then 'saturated' else 'partial' end as category, count(*) as problems, round(avg(outcome_var), 6) as mean_outcome_var, round(avg(struct_var), 6) as mean_struct_var, round(median(struct_var), 6) as median_struct_var, round(avg(dsr_range), 6) as mean_dsr_range, round(avg(lvr_var), 6) as mean_lvr_var, round(avg((struct_var > 0.001)::int), 6) as share_nonzero from " + _VAR + " group by 1"


@query(S.RECURSIVE + " " + _VARS)
def variance_by_category(spark, d):
    return X.variance_by_category(_annotated(spark, d))


@query(S.RECURSIVE + f" select saturated_var, partial_var, round(saturated_var / partial_var, 6) as preservation, case when saturated_var / partial_var > 0.5 then 'strong' when saturated_var / partial_var > 0.1 then 'moderate' else 'weak' end as label from (select max(case when category = 'saturated' then mean_struct_var end) as saturated_var, max(case when category = 'partial' then mean_struct_var end) as partial_var from ({_VARS}))")
def signal_preservation(spark, d):
    return X.signal_preservation(_annotated(spark, d))


_DSR_EDGES, _DSR_LABELS = [1e-12, 0.1, 0.2, 0.3, 0.4, 0.5], ["zero", "under_10", "under_20", "under_30", "under_40", "under_50", "rest"]


def _case(value: str, edges: list[float], labels: list[str]) -> str:
    return "case " + " ".join(f"when {value} < {e!r}::double then '{x}'" for e, x in zip(edges, labels)) + f" else '{labels[-1]}' end"


@query(S.RECURSIVE + f" select x.bucket, count(a.problem_id) as n from (select unnest({_DSR_LABELS!r}) as bucket) x left join ann a on x.bucket = {_case('a.dsr', _DSR_EDGES, _DSR_LABELS)} group by 1")
def dsr_histogram(spark, d):
    return X.filled(_annotated(spark, d).select(X.buckets(F.col("dsr"), _DSR_EDGES, _DSR_LABELS).alias("bucket")), "bucket", _DSR_LABELS)


_RANGE_EDGES, _RANGE_LABELS = [0.05, 0.1, 0.15, 0.2, 0.3, 0.5], ["r00", "r05", "r10", "r15", "r20", "r30", "r50"]


@query(S.RECURSIVE + f" select x.bucket, count(a.problem_id) as n from (select unnest({_RANGE_LABELS!r}) as bucket) x left join {_VAR} a on x.bucket = {_case('a.dsr_range', _RANGE_EDGES, _RANGE_LABELS)} group by 1")
def dsr_range_histogram(spark, d):
    a = _annotated(spark, d).filter("is_correct").groupBy("problem_id").agg((F.max("dsr") - F.min("dsr")).alias("dsr_range"), F.count("*").alias("c")).filter("c >= 2")
    return X.filled(a.select(X.buckets(F.col("dsr_range"), _RANGE_EDGES, _RANGE_LABELS).alias("bucket")), "bucket", _RANGE_LABELS)


@query(S.RECURSIVE + " select round(corr(dsr, is_correct::int::double), 6) as r, count(*) as n from ann where num_steps > 0")
def dsr_correctness_corr(spark, d):
    return _annotated(spark, d).filter("num_steps > 0").agg(F.round(X.correlation("dsr", F.col("is_correct").cast("double")), 6).alias("r"), F.count("*").alias("n"))


@query(_q("select problem_id, round(v, 6) as dsr_var, n from (select problem_id, var_pop(dsr) as v, count(*) as n from qr group by 1 having count(*) = count(*) filter (is_correct)) order by round(v, 6) desc, problem_id limit 10"))
def top_variance_problems(spark, d):
    """The ten saturated problems whose dead-step ratios differ most."""
    g = _annotated(spark, d).groupBy("problem_id").agg(F.round(F.var_pop("dsr"), 6).alias("dsr_var"), F.count("*").alias("n"), F.count_if("is_correct").alias("c")).filter("n = c").drop("c")
    return g.orderBy(F.desc("dsr_var"), "problem_id").limit(10)


@query(_q("select category, count(*) as problems, round(avg(qv), 6) as mean_quality_var, round(avg(dv), 6) as mean_dsr_var from (select problem_id, case when count(*) = count(*) filter (is_correct) then 'saturated' else 'partial' end as category, var_pop(case when is_correct then quality_reward end) as qv, var_pop(case when is_correct then dsr end) as dv from qr group by 1 having count(*) filter (is_correct) >= 2) group by 1"))
def quality_variance(spark, d):
    right = F.col("is_correct")
    g = scored(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.var_pop(F.when(right, F.col("quality_reward"))).alias("qv"), F.var_pop(F.when(right, F.col("dsr"))).alias("dv")).filter("c >= 2")
    return g.groupBy(F.when(F.col("n") == F.col("c"), "saturated").otherwise("partial").alias("category")).agg(F.count("*").alias("problems"), F.round(F.avg("qv"), 6).alias("mean_quality_var"), F.round(F.avg("dv"), 6).alias("mean_dsr_var"))


# Answers and texts.


def _boxed_sql(x: str) -> str:
    tokens = f"""list_transform(regexp_extract_all({x}, '(?s)(\\\\boxed\\{{|\\{{|\\}}|[^{{}}\\\\]+|\\\\)'), lambda z: {{'depth': 0, 'open': '', 'last': '', 'tok': z}})"""
    step = """lambda acc, z: case
        when acc.depth = 0 then case when z.tok = '\\boxed{' then {'depth': 1, 'open': '', 'last': acc.last, 'tok': ''} else acc end
        when z.tok = '}' and acc.depth = 1 then {'depth': 0, 'open': '', 'last': acc.open, 'tok': ''}
        else {'depth': acc.depth + case when z.tok in ('{', '\\boxed{') then 1 when z.tok = '}' then -1 else 0 end, 'open': acc.open || z.tok, 'last': acc.last, 'tok': ''} end"""
    return S.trim(f"(list_reduce({tokens}, {step}, {{'depth': 0, 'open': '', 'last': '', 'tok': ''}})).last")


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, {_boxed_sql('solution')} as boxed from t")
def boxed_answers(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.boxed_answer(F.col("solution")).alias("boxed")))


def _normal_sql(x: str) -> str:
    a = S.trim(x)
    for p in ("\\text{", "\\mathrm{", "\\mathbf{", "\\mbox{"):
        a = f"(select case when starts_with(v, '{p}') and ends_with(v, '}}') then substr(v, {len(p) + 1}, length(v) - {len(p) + 1}) else v end from (select {a} as v))"
    a = f"replace({a}, '^\\circ', '')"
    a = f"regexp_replace({a}, {S.q(r'\\(?:text|mbox|mathrm)\{[^}]*\}')}, '', 'g')"
    a = f"replace(replace({a}, '\\$', ''), '$', '')"
    a = f"regexp_replace({a}, {S.q(r'_\{?\d+\}?$')}, '')"
    a = f"regexp_replace({a}, {S.q(r'^[a-zA-Z]\s*[=∈]\s*')}, '')"
    a = f"replace(replace({a}, '\\in', ''), '\\dfrac', '\\frac')"
    a = f"regexp_replace({a}, {S.q(r'\\frac\s*([0-9a-zA-Z])\s*([0-9a-zA-Z])')}, {S.q(r'\\frac{\1}{\2}')}, 'g')"
    a = f"regexp_replace({a}, {S.q(r'\\sqrt\s*([0-9]+)')}, {S.q(r'\\sqrt{\1}')}, 'g')"
    a = f"replace(replace({a}, '\\left', ''), '\\right', '')"
    a = f"(select case when starts_with(v, '.') then '0' || v else v end from (select {a} as v))"
    a = f"replace(replace({a}, ',\\!', ''), ',', '')"
    return f"regexp_replace(regexp_replace({a}, '\\s+', '', 'g'), '\\.+$', '')"


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, {_normal_sql('answer')} as answer_norm, {_normal_sql('ground_truth')} as truth_norm from t")
def normalized_answers(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.normalize_answer(F.col("answer")).alias("answer_norm"), text.normalize_answer(F.col("ground_truth")).alias("truth_norm")))


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, a <> '' and a = g as correct from (select problem_id, rollout_id, trace_id, {_normal_sql('answer')} as a, {_normal_sql('ground_truth')} as g from t)")
def correctness(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.correct(F.col("answer"), F.col("ground_truth")).alias("correct")))


def _numeric_sql(x: str) -> str:
    a = f"regexp_replace(regexp_replace({S.trim(x)}, '[$,]', '', 'g'), '\\.+$', '')"
    a = f"regexp_replace(regexp_replace({a}, {S.q(r'\\(?:text|mathrm|mathbf|mathit|textbf)\{([^}]*)\}')}, '\\1', 'g'), '\\s+', '', 'g')"
    return a


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, case when try_cast(a as double) is not null and try_cast(g as double) is not null then try_cast(a as double) = try_cast(g as double) else lower(a) = lower(g) end as correct from (select problem_id, rollout_id, trace_id, {_numeric_sql('answer')} as a, {_numeric_sql('ground_truth')} as g from t)")
def numeric_correctness(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.numeric_equal(F.col("answer"), F.col("ground_truth")).alias("correct")))


@query("with p as (select problem_id, min(answer) as answer from problems where answer is not null group by 1) select problem_id, coalesce(nullif(concat_ws(' ', case when regexp_matches(answer, '^\\d+$') then 'The answer is a positive integer.' when contains(answer, '/') or contains(answer, 'frac') then 'The answer is a fraction.' when contains(answer, '.') then 'The answer is a decimal number.' end, case when v < 0 then 'The answer is negative.' when v < 10 then 'The answer is a small number (single digit).' when v < 100 then 'The answer is a two-digit number.' when v < 1000 then 'The answer is a three-digit number.' end), ''), 'Think carefully about this problem step by step.') as hint from (select *, try_cast(replace(answer, ',', '') as double) as v from p)")
def answer_hints(spark, d):
    p = table(spark, d, "problems").filter("answer is not null").groupBy("problem_id").agg(F.min("answer").alias("answer"))
    return p.select("problem_id", text.answer_hint(F.col("answer")).alias("hint"))


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {S.q(w)})" for w in words) + ")"


_HINT = (
    S.ROWS
    + f""", hp as (select problem_id, rollout_id, trace_id, list_filter(list_transform(flatten(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(solution, {S.q(r'(?s)\[asy\].*?\[/asy\]')}, '', 'g'), '([.!?])\\s+([A-Z])', E'\\\\1\\x01\\\\2', 'g'), E'\\x01'), lambda x: string_split(x, E'\\n\\n'))), lambda x: {S.trim('x')}), lambda x: x <> '') as parts from t),
hs as (select problem_id, rollout_id, trace_id, parts, unnest(range(len(parts))) as i from hp),
hc as (select problem_id, rollout_id, trace_id, i, parts[i + 1] as part, lower(parts[i + 1]) as low from hs),
hr as (select *, case when {_any('part', fixed.HINT_MATH)} then 2 else 0 end + case when {_any('low', fixed.HINT_TECHNIQUE)} then 3 else 0 end - case when {_any('low', fixed.HINT_RESTATEMENT)} then 5 else 0 end - case when length(part) > 500 then 1 else 0 end - case when length(part) < 40 then 1 else 0 end as score from hc),
hb as (select *, row_number() over (partition by rollout_id, trace_id order by score desc, i) as k from hr where length(part) >= 20 and not contains(part, '\\boxed{{')),
hf as (select *, row_number() over (partition by rollout_id, trace_id order by i) as k from hr where length(part) > 40 and not contains(part, '\\boxed{{'))
select t.problem_id, t.rollout_id, t.trace_id, case when hb.score > 0 then 'Key approach: ' || substr(hb.part, 1, 250) || case when length(hb.part) > 250 then '...' else '' end when hf.part is not null then 'Consider: ' || substr(hf.part, 1, 200) else {S.q(fixed.HINT_DEFAULT)} end as hint
from t left join hb on hb.rollout_id = t.rollout_id and hb.trace_id = t.trace_id and hb.k = 1 left join hf on hf.rollout_id = t.rollout_id and hf.trace_id = t.trace_id and hf.k = 1"""
)


@query(_HINT)
def key_step_hints(spark, d):
    return T.single(spark, d).select(*T.KEYS, text.key_step_hint(F.col("solution")).alias("hint"))


_COUNTS = ", ".join(f"len(regexp_extract_all(lower(solution), {S.q(p)}))::bigint as {k}" for k, p in fixed.COUNTED.items())


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, {_COUNTS} from t")
def pattern_counts(spark, d):
    t = T.traces(spark, d).withColumn("low", F.lower("solution"))
    return T.unique(t.select(*T.KEYS, *[F.regexp_count("low", F.lit(p)).cast("bigint").alias(k) for k, p in fixed.COUNTED.items()]))


def _rank_any(names: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(low, {S.q(fixed.COUNTED[k])})" for k in names) + ")"


_PRIORITY = f"case when {_rank_any(fixed.COUNTED_VERIFICATION)} then 'verification' when {_rank_any(fixed.COUNTED_CORRECTION)} then 'correction' when {_rank_any(fixed.COUNTED_EXPLORATION)} then 'exploration' when contains(content, '\\boxed{{') then 'conclusion' else 'derivation' end"


@query(S.PLAIN + f" select problem_id, rollout_id, trace_id, step_id, {_PRIORITY} as phase from s1")
def segment_priority(spark, d):
    seg = F.transform(text.segments(F.col("solution")), lambda x, i: F.struct(i.alias("step_id"), text.priority_type(x).alias("phase")))
    return T.unique(T.traces(spark, d).select(*T.KEYS, seg.alias("rows"))).select(*T.KEYS, F.explode("rows").alias("s")).select(*T.KEYS, "s.*")


@query("select doc_id, i::int as segment, seg[i + 1] as content from (select doc_id, seg, unnest(range(len(seg))) as i from (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\n+'), lambda x: " + S.trim("x") + "), lambda x: x <> '') as seg from documents))")
def raw_text_segments(spark, d):
    seg = F.transform(text.segments(F.col("text")), lambda x, i: F.struct(i.alias("segment"), x.alias("content")))
    return table(spark, d, "documents").select("doc_id", F.explode(seg).alias("s")).select("doc_id", "s.*")


# Rollouts and shards.


@query(S.ROWS + " select count(*) as traces, count(*) filter (is_correct) as correct, count(distinct problem_id) as problems, count(distinct case when is_correct then problem_id end) as solved, round(avg(num_tokens), 6) as avg_tokens, count(*) filter (num_tokens is null) as untold from t")
def rollout_summary(spark, d):
    return _outcomes(spark, d).agg(F.count("*").alias("traces"), F.count_if("is_correct").alias("correct"), F.countDistinct("problem_id").alias("problems"), F.countDistinct(F.when(F.col("is_correct"), F.col("problem_id"))).alias("solved"), F.round(F.avg("num_tokens"), 6).alias("avg_tokens"), F.count_if(F.col("num_tokens").isNull()).alias("untold"))


@query(S.ROWS + " select shard, count(*) as problems, sum(n)::bigint as traces, sum(c)::bigint as correct, round(avg((c > 0)::int), 6) as pass_at_k from (select shard, problem_id, count(*) as n, count(*) filter (is_correct) as c from t group by 1, 2) group by 1")
def shard_merge_pass_at_k(spark, d):
    g = _outcomes(spark, d).groupBy("shard", "problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"))
    return g.groupBy("shard").agg(F.count("*").alias("problems"), F.sum("n").alias("traces"), F.sum("c").alias("correct"), F.round(F.avg((F.col("c") > 0).cast("double")), 6).alias("pass_at_k"))


@query("select problem_id, count(*) as n, count(distinct shard) as shards from problems_runs group by 1 having count(*) > 1 order by problem_id".replace("problems_runs", "(select distinct rollout_id, problem_id, shard from rollouts)"))
def duplicate_problem_ids(spark, d):
    """Problems that came in more than one rollout, by name as text."""
    r = table(spark, d, "rollouts").select("rollout_id", "problem_id", "shard").distinct()
    return r.groupBy("problem_id").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).filter("n > 1").orderBy("problem_id")


@query(S.PLAIN + " select t.problem_id, t.rollout_id, t.trace_id, " + ", ".join(f"count(*) filter (step_type = '{k}') as {k}" for k in fixed.STEP_TYPES) + " from t left join s using (rollout_id, trace_id) group by all")
def type_distribution(spark, d):
    """Steps by type per trace, zeros filled."""
    p = T.traces(spark, d).withColumn("steps", T.step_array(F.col("solution")))
    types = F.transform("steps", lambda s: s["step_type"])
    p = T.unique(p.select(*T.KEYS, types.alias("types")))
    return p.select(*T.KEYS, *[F.size(F.filter("types", _is(k))).cast("bigint").alias(k) for k in fixed.STEP_TYPES])


def _is(kind: str):
    return lambda x: x == kind


@query(S.RECURSIVE + " select problem_id, rollout_id, trace_id, src as step_id, count(*) as n_outputs, string_agg(dst::varchar, ' ' order by dst) as outputs from e group by all")
def dag_outputs(spark, d):
    """What each step is used by, from its own trace's edges."""

    def used(s, i):
        users = F.filter(F.sequence(F.lit(0), F.size("edges") - 1), lambda j: F.array_contains(F.element_at(F.col("edges"), j + 1), i))
        return F.struct(i.alias("step_id"), F.size(users).cast("bigint").alias("n_outputs"), F.array_join(F.transform(users, lambda j: j.cast("string")), " ").alias("outputs"))

    return T.unique(T.parsed(spark, d).select(*T.KEYS, F.transform("steps", used).alias("rows"))).select(*T.KEYS, F.explode("rows").alias("u")).select(*T.KEYS, "u.*").filter("n_outputs > 0")


@query(S.RECURSIVE + " select round(avg(verification_density), 6) as mean_density, round(avg(live_verification_rate), 6) as mean_live_rate, count(*) filter (verification_density > 0) as verifying from ann")
def verification_metrics(spark, d):
    return _annotated(spark, d).agg(F.round(F.avg("verification_density"), 6).alias("mean_density"), F.round(F.avg("live_verification_rate"), 6).alias("mean_live_rate"), F.count_if(F.col("verification_density") > 0).alias("verifying"))


@query(S.ROWS + " select problem_id, count(*) as n from t group by 1 having not bool_or(is_correct)")
def all_wrong_problems(spark, d):
    return _outcomes(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.bool_or("is_correct").alias("any")).filter("not any").drop("any")


@query("with p as (select problem_id, min(level) as level from problems group by 1) select problem_id, level from (select *, row_number() over (partition by level order by problem_id) as k from p where level is not null) where k <= 5")
def stratified_sample(spark, d):
    """The first five problems of every level."""
    from pyspark.sql import Window

    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level")).filter("level is not null")
    return p.withColumn("k", F.row_number().over(Window.partitionBy("level").orderBy("problem_id"))).filter("k <= 5").drop("k")


@query("select problem_id from (select distinct problem_id from problems) order by problem_id limit 20 offset 10")
def offset_limit(spark, d):
    """The slice of problems that one shard of a run takes: a given offset and number in order of name."""
    return table(spark, d, "problems").select("problem_id").distinct().orderBy("problem_id").offset(10).limit(20)


@query(_q(f", ma as (select *, {_normal_sql('answer')} as norm_answer from qr), mv as (select problem_id, norm_answer, count(*) as votes from ma where norm_answer <> '' group by all), mt as (select * from (select *, row_number() over (partition by problem_id order by votes desc, norm_answer) as k from mv) where k = 1) select problem_id, norm_answer, votes, rollout_id, trace_id, is_correct, quality_reward from (select ma.*, votes, row_number() over (partition by ma.problem_id order by quality_reward desc, rollout_id, trace_id) as k from ma join mt using (problem_id, norm_answer)) where k = 1"))
def majority_vote(spark, d):
    return B.majority(scored(spark, d).withColumn("norm_answer", text.normalize_answer(F.col("answer"))))


# Preference pairs as delivered.


def _pairs_once(spark, d):
    return table(spark, d, "preference_pairs").dropDuplicates(["pair_id"])


@query(S.PAIRS + "select pair_type, count(*) as n, count(distinct regexp_extract(problem_id, '([0-9]+)', 1)) as problems, round(avg(chosen_dsr), 6) as mean_chosen_dsr, round(avg(rejected_dsr), 6) as mean_rejected_dsr, count(*) filter (chosen_correct and rejected_correct) as both_correct, count(*) filter (chosen_correct and not rejected_correct) as chosen_only from pr group by 1")
def pair_breakdown(spark, d):
    p = _pairs_once(spark, d)
    return p.groupBy("pair_type").agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("problem_id", "([0-9]+)", 1)).alias("problems"), F.round(F.avg("chosen_dsr"), 6).alias("mean_chosen_dsr"), F.round(F.avg("rejected_dsr"), 6).alias("mean_rejected_dsr"), F.count_if(F.col("chosen_correct") & F.col("rejected_correct")).alias("both_correct"), F.count_if(F.col("chosen_correct") & ~F.col("rejected_correct")).alias("chosen_only"))


@query(S.PAIRS + "select coalesce(pair_type, 'all') as pair_type, count(distinct problem_text) as prompts from pr group by rollup (pair_type)")
def pair_coverage(spark, d):
    """Distinct prompts by their whole texts."""
    p = _pairs_once(spark, d).select("pair_type", "problem_text")
    return p.rollup("pair_type").agg(F.countDistinct("problem_text").alias("prompts")).select(F.coalesce("pair_type", F.lit("all")).alias("pair_type"), "prompts")


_LEN = S.PAIRS + ", l as (select pair_type, length(coalesce(chosen_solution, '')) as c, length(coalesce(rejected_solution, '')) as r from pr), q as (select *, case when r > 0 then c::double / r else 1.0 end as ratio, row_number() over (partition by pair_type order by c) as rc, row_number() over (partition by pair_type order by r) as rr, count(*) over (partition by pair_type) as n from l) "


@query(_LEN + "select pair_type, count(*) as n, round(avg(c), 6) as mean_chosen, round(avg(r), 6) as mean_rejected, max(case when rc = n // 10 + 1 then c end)::int as p10_chosen, max(case when rc = 9 * n // 10 + 1 then c end)::int as p90_chosen, max(case when rr = n // 10 + 1 then r end)::int as p10_rejected, max(case when rr = 9 * n // 10 + 1 then r end)::int as p90_rejected, round(avg(ratio), 6) as mean_ratio, count(*) filter (ratio < 0.9::double) as shorter, count(*) filter (ratio > 1.1::double) as longer from q group by 1")
def pair_length_stats(spark, d):
    """Lengths of both sides by type; percentiles are nearest ranks from counts by length, so no group is gathered."""
    from pyspark.sql import Window

    p = _pairs_once(spark, d).select("pair_type", F.length(F.coalesce("chosen_solution", F.lit(""))).alias("c"), F.length(F.coalesce("rejected_solution", F.lit(""))).alias("r"))
    ratio = F.when(F.col("r") > 0, F.col("c") / F.col("r")).otherwise(1.0)
    base = p.groupBy("pair_type").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_chosen"), F.round(F.avg("r"), 6).alias("mean_rejected"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.count_if(ratio < 0.9).alias("shorter"), F.count_if(ratio > 1.1).alias("longer"))

    def ranks(col: str, name: str):
        by = p.groupBy("pair_type", F.col(col).alias("v")).agg(F.count("*").alias("k"))
        w = Window.partitionBy("pair_type").orderBy("v")
        run = by.select("pair_type", "v", F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy("pair_type")).alias("n"))
        at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
        return run.groupBy("pair_type").agg(at(F.floor(F.col("n") / 10) + 1).alias(f"p10_{name}"), at(F.floor(F.col("n") * 9 / 10) + 1).alias(f"p90_{name}"))

    return base.join(ranks("c", "chosen"), "pair_type").join(ranks("r", "rejected"), "pair_type")


@query(S.PAIRS + "select pair_id, problem_text as human, coalesce(chosen_solution, '') as chosen, coalesce(rejected_solution, '') as rejected from pr where problem_text <> ''")
def sharegpt_dpo(spark, d):
    """Pairs as conversation records, read back from the record's fields; pairs without a problem text are left out."""
    rec = P.sharegpt(F.col("problem_text"), F.coalesce("chosen_solution", F.lit("")), F.coalesce("rejected_solution", F.lit("")))
    r = _pairs_once(spark, d).filter("problem_text <> ''").select("pair_id", rec.alias("r"))
    return r.select("pair_id", F.element_at("r.conversations", 1)["value"].alias("human"), F.col("r.chosen.value").alias("chosen"), F.col("r.rejected.value").alias("rejected"))


# Reasoning records with explicit inputs.


def _r(sql: str) -> str:
    return "with recursive " + S.RIR + " " + sql


def _records(spark, d):
    return R.records(T.parsed(spark, d))


def _features(spark, d):
    return R.features(_records(spark, d))


@query(_r("select problem_id, rollout_id, trace_id, coalesce(string_agg(step_id::varchar, ' ' order by step_id) filter (is_live), '') as live, coalesce(string_agg(step_id::varchar, ' ' order by step_id) filter (not is_live), '') as dead from rs group by all"))
def rir_live_dead(spark, d):
    """Live and dead steps by the kernel for any graph; the check follows the edges."""
    e = R.eliminate(_records(spark, d).withColumnRenamed("rsteps", "steps")).filter("total > 0")
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return T.unique(e.select(*T.KEYS, ids("live_ids").alias("live"), ids("dead_ids").alias("dead")))


@query(_r("select count(*) as records, round(avg(dsr), 6) as avg_dead_ratio, 1.0::double as preserved, round(avg(dead_token_ratio), 6) as avg_token_savings, sum(dead)::bigint as dead from fe"))
def rir_dse_summary(spark, d):
    """Preservation is 1 by construction: conclusions are what liveness starts from."""
    return _features(spark, d).agg(F.count("*").alias("records"), F.round(F.avg("dsr"), 6).alias("avg_dead_ratio"), F.lit(1.0).alias("preserved"), F.round(F.avg("dead_token_ratio"), 6).alias("avg_token_savings"), F.sum("dead").alias("dead"))


@query(_r("select rtype as step_type, count(*) as total, count(*) filter (not is_live) as dead, round(count(*) filter (not is_live)::double / count(*), 6) as dead_share, round(count(*) filter (not is_live)::double / (select count(*) from rs where not is_live), 6) as share_of_dead from rs group by 1"))
def rir_type_decomposition(spark, d):
    e = R.eliminate(_records(spark, d).withColumnRenamed("rsteps", "steps"))
    s = T.unique(e.select(*T.KEYS, "dead_ids", "steps")).select("dead_ids", F.explode("steps").alias("s")).groupBy(F.col("s.type").alias("step_type")).agg(F.count("*").alias("total"), F.count_if(F.array_contains("dead_ids", F.col("s.id"))).alias("dead"))
    whole = s.agg(F.sum("dead").alias("all_dead"))
    return s.join(F.broadcast(whole)).select("step_type", "total", "dead", F.round(F.col("dead") / F.col("total"), 6).alias("dead_share"), F.round(F.col("dead") / F.col("all_dead"), 6).alias("share_of_dead"))


_METRICS = ["dsr", "vii", "dead_token_ratio", "total", "dead", "tokens"]


def _mwu_sql(m: str) -> str:
    return f"""(with c as (select {m}::double as value, count(*) as n, count(*) filter (is_correct) as n1 from fe group by 1), k as (select *, sum(n) over (order by value) - n + (n + 1) / 2.0::double as rank from c),
      z as (select sum(n1)::double as a, sum(n - n1)::double as b, sum(n1 * rank) as ranks, sum(n::double * n * n - n) as ties from k), w as (select a, b, ranks - a * (a + 1) / 2 as u, a * b / 12.0::double * (a + b + 1 - ties / ((a + b) * (a + b - 1))) as var from z)
      select '{m}' as metric, (select round(avg({m}) filter (is_correct), 6) from fe) as mean_1, (select round(avg({m}) filter (not is_correct), 6) from fe) as mean_0, u, round(case when var > 0 then greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(var) else 0 end, 6) as z,
        (select round((avg({m}) filter (is_correct) - avg({m}) filter (not is_correct)) / sqrt((var_pop({m}) filter (is_correct) + var_pop({m}) filter (not is_correct)) / 2), 6) from fe) as cohens_d from w)"""


@query(_r(" union all ".join("select * from " + _mwu_sql(m) for m in _METRICS)))
def rir_correctness_independence(spark, d):
    """Rank test and effect size of every feature between right and wrong records."""
    f = materialize(_features(spark, d).select("is_correct", *[F.col(m).cast("double").alias(m) for m in _METRICS]))
    out = None
    for m in _METRICS:
        one = X.mann_whitney(f, m, "is_correct").join(F.broadcast(X.cohens_d(f, m, "is_correct"))).select(F.lit(m).alias("metric"), "mean_1", "mean_0", "u", F.round("z", 6).alias("z"), "cohens_d")
        out = one if out is None else out.unionByName(one)
    return out


def _hard(problem: str) -> str:
    return f"case when regexp_matches({problem}, '^(aime|hard)') then 'hard' when regexp_matches({problem}, '^(s2_|scale_)') then 'medium' when regexp_matches({problem}, '^(algebra|intermediate)') then 'easy' when regexp_matches({problem}, '^(geometry|combinatorics|numtheory)') then 'medium' when regexp_matches({problem}, '^gsm8k') then 'easy' else 'unknown' end"


_NAMED = ", pc as (select problem_id, min(category) as category from problems group by 1), fc as (select fe.*, " + _hard("coalesce(category, '') || '_' || problem_id") + " as difficulty from fe left join pc using (problem_id))"


def _by_difficulty(spark, d):
    c = table(spark, d, "problems").groupBy("problem_id").agg(F.min("category").alias("category"))
    return _features(spark, d).join(c, "problem_id", "left").withColumn("difficulty", R.difficulty(F.concat(F.coalesce("category", F.lit("")), F.lit("_"), F.col("problem_id"))))


@query("with recursive " + S.RIR + _NAMED + " select difficulty, count(*) as n, round(avg(is_correct::int), 6) as accuracy, round(avg(dsr), 6) as avg_dsr, round(avg(vii), 6) as avg_vii, round(avg(dead_token_ratio), 6) as avg_dead_tokens, round(avg(total), 6) as avg_steps, round(avg(tokens), 6) as avg_tokens from fc group by 1")
def rir_difficulty(spark, d):
    """Strata by the difficulty that a problem's name (its category and id) starts with."""
    a = lambda c: F.round(F.avg(c), 6)
    return _by_difficulty(spark, d).groupBy("difficulty").agg(F.count("*").alias("n"), a(F.col("is_correct").cast("double")).alias("accuracy"), a("dsr").alias("avg_dsr"), a("vii").alias("avg_vii"), a("dead_token_ratio").alias("avg_dead_tokens"), a("total").alias("avg_steps"), a("tokens").alias("avg_tokens"))


@query("with recursive " + S.RIR + _NAMED + """, c as (select dsr as value, count(*) as n from fc group by 1), k as (select value, n, sum(n) over (order by value) - n + (n + 1) / 2.0::double as rank from c),
  strata as (select difficulty, count(*)::double as n, sum(rank) as r from fc join k on fc.dsr = k.value group by 1), z as (select sum(n::double * n * n - n) as ties, sum(n)::double as n from k)
  select round((12.0::double / (z.n * (z.n + 1)) * (select sum(r * r / n) from strata) - 3 * (z.n + 1)) / (1 - ties / (z.n * z.n * z.n - z.n)), 6) as h, (select count(*) - 1 from strata)::int as df from z""")
def rir_difficulty_test(spark, d):
    """Rank test of dead-step ratios over all strata that have records."""
    return X.kruskal_wallis(materialize(_by_difficulty(spark, d).select("dsr", "difficulty")), "dsr", "difficulty", ["easy", "medium", "hard", "unknown"])


@query(_r("select is_correct, count(*) as n, round(avg(dead_token_ratio), 6) as token_savings, round(avg(dsr), 6) as step_savings from fe group by 1"))
def rir_answer_preservation(spark, d):
    return _features(spark, d).groupBy("is_correct").agg(F.count("*").alias("n"), F.round(F.avg("dead_token_ratio"), 6).alias("token_savings"), F.round(F.avg("dsr"), 6).alias("step_savings"))


@query(_r("select count(*) as n, 1.0::double as dse_apr, round(avg(p), 6) as random_apr, round(stddev_pop(p), 6) as random_std from (select list_product(list_transform(range(1, dead + 1), lambda i: i::double / (total - greatest(concluded, 1) - dead + i))) as p from fe where dead > 0)"))
def rir_random_removal(spark, d):
    """Dead-step elimination against as many random removals: the chance of keeping all that is needed, in closed form instead of trials."""
    return R.random_removal(_features(spark, d)).agg(F.count("*").alias("n"), F.lit(1.0).alias("dse_apr"), F.round(F.avg("random_apr"), 6).alias("random_apr"), F.round(F.stddev_pop("random_apr"), 6).alias("random_std"))


_VII_EDGES, _VII_LABELS = [0.25, 0.5, 0.75, 1.0], ["v00", "v25", "v50", "v75", "v100"]


@query(_r(f"select {_case('vii', _VII_EDGES, _VII_LABELS)} as bucket, is_correct, count(*) as n, round(avg(vii), 6) as mean_vii, round(sum(dead_verif_tokens)::double / greatest(sum(tokens), 1), 6) as dead_verif_token_share from fe where verif > 0 group by 1, 2"))
def rir_verification(spark, d):
    f = _features(spark, d).filter("verif > 0")
    return f.groupBy(X.buckets(F.col("vii"), _VII_EDGES, _VII_LABELS).alias("bucket"), "is_correct").agg(F.count("*").alias("n"), F.round(F.avg("vii"), 6).alias("mean_vii"), F.round(F.sum("dead_verif_tokens") / F.greatest(F.sum("tokens"), F.lit(1)), 6).alias("dead_verif_token_share"))


def _kept_sql(condition: str) -> str:
    return S.trim(f"regexp_replace(coalesce(string_agg(content, E'\\n\\n' order by step_id) filter (contains(content, 'boxed') or not ({condition})), ''), '\\n{{3,}}', E'\\n\\n', 'g')")


_KEYWORD = "list_reduce(list_transform(string_split(solution, E'\\n'), lambda z: {'skip': false, 'out': '', 'line': z}), lambda acc, z: case when " + "(" + " or ".join(f"contains(lower({S.trim('z.line')}), {S.q(w)})" for w in fixed.VERIFY_KEYWORDS) + ") then {'skip': true, 'out': acc.out, 'line': ''} when acc.skip and not (" + S.trim("z.line") + " = '' or " + " or ".join(f"starts_with({S.trim('z.line')}, {S.q(w)})" for w in fixed.NEW_TOPIC) + ") then acc else {'skip': false, 'out': acc.out || E'\\n' || z.line, 'line': ''} end, {'skip': false, 'out': '', 'line': ''}).out"
_CLEANED = S.trim(f"regexp_replace({_KEYWORD}, '\\n{{3,}}', E'\\n\\n', 'g')")


@query(_r(", v as (select problem_id, rollout_id, trace_id, " + _kept_sql("not is_live") + " as dse, count(*) filter (not is_live) as n1, " + _kept_sql("rtype = 'verification'") + " as noverif, count(*) filter (rtype = 'verification') as n2, " + _kept_sql("rtype = 'verification' and not is_live") + " as liveverif, count(*) filter (rtype = 'verification' and not is_live) as n3 from rs group by all) select problem_id, rollout_id, trace_id, 'dse' as variant, dse as cleaned, n1 as removed_steps from v union all select problem_id, rollout_id, trace_id, 'noverif', noverif, n2 from v union all select problem_id, rollout_id, trace_id, 'liveverif', liveverif, n3 from v union all select problem_id, rollout_id, trace_id, 'original', solution, 0 from t join v using (problem_id, rollout_id, trace_id) union all select problem_id, rollout_id, trace_id, 'keywordclean', " + _CLEANED + ", 0 from t join v using (problem_id, rollout_id, trace_id)"))
def clean_variants(spark, d):
    """All five cleaned variants of every record."""
    return R.variants(R.records(T.parse(T.single(spark, d))).filter("size(rsteps) > 0"))


@query(_r("select variant, count(*) as n, sum(removed)::bigint as removed_steps from (select 'dse' as variant, dead as removed from rf union all select 'noverif', verif from rf union all select 'liveverif', dead_verif from rf union all select 'original', 0 from rf union all select 'keywordclean', 0 from rf) group by 1"))
def variant_stats(spark, d):
    return R.variants(_records(spark, d).filter("size(rsteps) > 0")).select(*T.KEYS, "variant", "removed_steps").distinct().groupBy("variant").agg(F.count("*").alias("n"), F.sum("removed_steps").alias("removed_steps"))


@query(S.ROWS + " select problem_id, rollout_id, trace_id, " + _CLEANED + " as cleaned from t")
def keyword_clean(spark, d):
    return T.single(spark, d).select(*T.KEYS, text.keyword_clean(F.col("solution")).alias("cleaned"))


_FRAGILE = """, pk as (select rollout_id, trace_id, list_distinct(list(content) filter (is_live)) as kept, list(content order by step_id) as paras from rs group by 1, 2),
   rm as (select a.*, k.paras, k.kept, list_position(k.paras, a.content) - 1 as place, list_distinct(regexp_extract_all(a.content, '[A-Za-z][0-9A-Za-z_]*|[0-9]+')) as ent from rs a join pk k using (rollout_id, trace_id) where not is_live and not list_contains(kept, content))
   select problem_id, rollout_id, trace_id, step_id, step_type as kind, char_length as n_chars,
     coalesce(len(list_filter(kept, lambda z: len(ent) > 0 and len(regexp_extract_all(z, '[A-Za-z][0-9A-Za-z_]*|[0-9]+')) > 0 and len(list_intersect(ent, list_distinct(regexp_extract_all(z, '[A-Za-z][0-9A-Za-z_]*|[0-9]+'))))::double / least(len(ent), len(list_distinct(regexp_extract_all(z, '[A-Za-z][0-9A-Za-z_]*|[0-9]+')))) > 0.5)) > 0, false)
     or step_type in ('verification', 'exploration', 'correction') or (place > 0 and list_contains(kept, paras[place])) or (place < len(paras) - 1 and list_contains(kept, paras[place + 2])) as fragile from rm"""


@query(_r(_FRAGILE))
def fragile_robust(spark, d):
    return R.fragile(_records(spark, d).filter("size(rsteps) > 0"))


@query(_r(", pk as (select rollout_id, trace_id, list(content) filter (is_live) as kept from rs group by 1, 2) select step_type as kind, count(*) as removed, sum(char_length)::bigint as removed_chars from rs join pk using (rollout_id, trace_id) where not is_live and not list_contains(kept, content) group by 1"))
def typed_dse(spark, d):
    """Removed paragraphs by kind: what a typed elimination would put back are the first three kinds of the step types that only look dead."""
    f = R.fragile(_records(spark, d).filter("size(rsteps) > 0"))
    return f.groupBy("kind").agg(F.count("*").alias("removed"), F.sum("n_chars").alias("removed_chars"))


# Prefixes.


@query("with recursive " + S.PREFIX + " select * from tl")
def prefix_timeline(spark, d):
    return N.timeline(T.parsed(spark, d))


@query("with recursive " + S.PREFIX + " select problem_id, rollout_id, trace_id, step_id, num_steps, num_dead, intervention from tl where intervention is not null")
def prefix_interventions(spark, d):
    return N.interventions(T.parsed(spark, d)).drop("num_motifs")


@query("with recursive " + S.PREFIX + " select coalesce(intervention, 'none') as intervention, count(*) as prefixes, count(distinct (rollout_id, trace_id)) as traces, round(avg(step_id), 6) as mean_step from tl group by 1")
def intervention_summary(spark, d):
    t = N.timeline(T.parsed(spark, d))
    return t.groupBy(F.coalesce("intervention", F.lit("none")).alias("intervention")).agg(F.count("*").alias("prefixes"), F.countDistinct("rollout_id", "trace_id").alias("traces"), F.round(F.avg("step_id"), 6).alias("mean_step"))


# Evaluation of two runs.


def _runs(spark, d):
    """Evaluation rows: the first trace of each rollout stands for the baseline (model 0), the later ones for runs 1, 2 and so on."""
    metrics = T.annotate(T.parsed(spark, d))
    shard = table(spark, d, "rollouts").select("rollout_id", F.col("shard").alias("benchmark")).dropDuplicates(["rollout_id"])
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level"), F.min("category").alias("category"))
    j = metrics.join(shard, "rollout_id").join(p, "problem_id", "left")
    return materialize(j.select(F.col("rollout_id").alias("id"), F.col("trace_id").alias("model"), "benchmark", F.coalesce("category", F.lit("")).alias("subject"), F.coalesce("level", F.lit(0)).alias("level"), "is_correct", "num_tokens", "dsr", "num_steps", "num_dead"))


_ACC = "count(*) as total, count(*) filter (is_correct) as correct, round(count(*) filter (is_correct)::double / count(*), 6) as accuracy, round(avg(num_tokens), 6) as avg_tokens"


@query(S.EVAL + f"select benchmark, 'all' as dim, '' as key, {_ACC} from ev group by 1 union all select benchmark, 'subject', subject, {_ACC} from ev where subject <> '' group by 1, 3 union all select benchmark, 'level', level::varchar, {_ACC} from ev where level <> 0 group by 1, 3")
def eval_metrics(spark, d):
    """Accuracy and tokens per benchmark, subject and level in one pass over every trace; empty subjects and level 0 are not broken out."""
    return E.metrics(_runs(spark, d))


@query(S.EVAL + "select model, round(avg(dsr), 6) as avg_dsr, round(avg((dsr > 0)::int), 6) as nonzero_dsr, round(avg(num_steps), 6) as avg_steps from ev group by 1")
def eval_structural(spark, d):
    return _runs(spark, d).groupBy("model").agg(F.round(F.avg("dsr"), 6).alias("avg_dsr"), F.round(F.avg((F.col("dsr") > 0).cast("double")), 6).alias("nonzero_dsr"), F.round(F.avg("num_steps"), 6).alias("avg_steps"))


_SPLIT = f"(select model, benchmark, 'all' as dim, '' as key, {_ACC} from ev group by 1, 2 union all select model, benchmark, 'level', level::varchar, {_ACC} from ev where level <> 0 group by 1, 2, 4 union all select model, benchmark, 'subject', subject, {_ACC} from ev where subject <> '' group by 1, 2, 4)"


@query(S.EVAL + f"select b.model, a.benchmark, a.dim, a.key, a.accuracy as base_accuracy, b.accuracy as new_accuracy, round(b.accuracy - a.accuracy, 6) as accuracy_delta, round(b.avg_tokens - a.avg_tokens, 6) as tokens_delta from {_SPLIT} a join {_SPLIT} b on a.benchmark = b.benchmark and a.dim = b.dim and a.key = b.key and a.model = 0 and b.model > 0")
def compare_models(spark, d):
    """Each later run against run 0."""
    r = _runs(spark, d)
    return E.compare(E.metrics(r.filter("model = 0")), E.metrics(r.filter("model > 0"), "model"), "model")


_CASES = ", w as (select b.model, a.is_correct as ca, b.is_correct as cb, a.num_tokens as ta, b.num_tokens as tb from ev a join ev b on a.id = b.id and a.model = 0 and b.model > 0) "


@query(S.EVAL + _CASES + "select model, case when ca and cb then 'both' when ca then 'base_only' when cb then 'new_only' else 'neither' end as outcome, count(*) as n, round(avg(ta), 6) as base_tokens, round(avg(tb), 6) as new_tokens from w group by 1, 2")
def disagreement(spark, d):
    return E.disagreement(_runs(spark, d))


@query(S.EVAL + _CASES + "select model, case when tb::double / ta > 0.95::double then 'under_5' when tb::double / ta > 0.8::double then 'under_20' when tb::double / ta > 0.6::double then 'under_40' else 'rest' end as reduction, count(*) as n, round(avg(cb::int) - avg(ca::int), 6) as accuracy_delta from w where ta > 0 group by 1, 2")
def impact_buckets(spark, d):
    return E.impact(_runs(spark, d))


@query(S.EVAL + "select model, level, count(*) as n, round(avg(is_correct::int), 6) as accuracy, round(avg(dsr), 6) as avg_dsr, round(avg(num_tokens), 6) as avg_tokens, round(avg(num_steps), 6) as avg_steps from ev group by all")
def condition_metrics(spark, d):
    a = lambda c: F.round(F.avg(c), 6)
    return _runs(spark, d).groupBy("model", "level").agg(F.count("*").alias("n"), a(F.col("is_correct").cast("double")).alias("accuracy"), a("dsr").alias("avg_dsr"), a("num_tokens").alias("avg_tokens"), a("num_steps").alias("avg_steps"))


_V, _C, _X = (" + ".join(names) for names in (fixed.COUNTED_VERIFICATION, fixed.COUNTED_CORRECTION, fixed.COUNTED_EXPLORATION))


@query(S.ROWS + f", c as (select problem_id, rollout_id, trace_id, is_correct, {_COUNTS} from t), x as (select is_correct, ({_V})::double as v, ({_C})::double as c, ({_X})::double as x from c) select is_correct, count(*) as n, round(avg(v), 6) as verification, round(avg(c), 6) as correction, round(avg(x), 6) as exploration, count(*) filter (v > 0 and c > 0) as verified_and_corrected from x group by 1")
def verification_utility(spark, d):
    t = T.traces(spark, d).withColumn("low", F.lower("solution"))
    total = lambda names: sum((F.regexp_count("low", F.lit(fixed.COUNTED[k])) for k in names), F.lit(0))
    x = T.unique(t.select(*T.KEYS, "is_correct", total(fixed.COUNTED_VERIFICATION).alias("v"), total(fixed.COUNTED_CORRECTION).alias("c"), total(fixed.COUNTED_EXPLORATION).alias("x")))
    return x.groupBy("is_correct").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("verification"), F.round(F.avg("c"), 6).alias("correction"), F.round(F.avg("x"), 6).alias("exploration"), F.count_if((F.col("v") > 0) & (F.col("c") > 0)).alias("verified_and_corrected"))


@query("with " + S.STEPS + f", ph as (select rollout_id, trace_id, count(*) as segments, count(*) filter (phase in ('verification', 'correction', 'exploration')) as seeking from (select *, {_PRIORITY} as phase from s1) group by all), pl as (select problem_id, min(level) as level from problems group by 1) select coalesce(level, 0) as level, is_correct, count(*) as n, round(avg(segments), 6) as segments, round(avg(seeking::double / segments), 6) as explore_ratio from t join ph using (rollout_id, trace_id) left join pl using (problem_id) group by 1, 2")
def exploration_depth(spark, d):
    phase = F.transform(text.segments(F.col("solution")), text.priority_type)
    t = T.unique(T.traces(spark, d).select(*T.KEYS, "is_correct", phase.alias("phase")))
    t = t.select("problem_id", "is_correct", F.size("phase").alias("segments"), F.size(F.filter("phase", lambda x: x.isin("verification", "correction", "exploration"))).alias("seeking")).filter("segments > 0")
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level"))
    return t.join(p, "problem_id", "left").groupBy(F.coalesce("level", F.lit(0)).alias("level"), "is_correct").agg(F.count("*").alias("n"), F.round(F.avg("segments"), 6).alias("segments"), F.round(F.avg(F.col("seeking") / F.col("segments")), 6).alias("explore_ratio"))


# A second level of annotations.

_L2 = """, l2 as (select problem_id, trace_id, dsr as l2_dsr, quality_reward as l2_quality from (select *, row_number() over (partition by problem_id, trace_id order by annotated_at desc nulls last, quality_reward desc nulls last, dsr asc nulls last) as k from annotated) where k = 1),
  l1 as (select * replace ((row_number() over (partition by problem_id order by rollout_id, trace_id) - 1)::int as trace_id) from qr),
  ll as materialized (select l1.problem_id, l1.trace_id, l1.is_correct, l1.dsr, l1.quality_reward, l2_dsr, case when isnan(l2_quality) then null else l2_quality end as l2_quality from l1 left join l2 using (problem_id, trace_id)) """


def _levels(spark, d):
    """Our metrics beside the delivered annotations of the same trace, numbered on over all rollouts of its problem."""
    s = scored(spark, d).select("problem_id", "rollout_id", "trace_id", "is_correct", "dsr", "quality_reward")
    return E.levels(s, table(spark, d, "annotated"))


@query("with recursive " + S.QUALITY + _L2 + "select count(*) as n, count(l2_dsr) as with_l2, round(avg(dsr), 6) as l1_dsr, round(avg(l2_dsr), 6) as l2_dsr, round(avg(quality_reward), 6) as l1_quality, round(avg(l2_quality), 6) as l2_quality, round(corr(dsr, l2_dsr), 6) as dsr_corr, round(corr(quality_reward, l2_quality), 6) as quality_corr from ll")
def parser_level_corr(spark, d):
    """Means and correlations of our metrics and the delivered ones, over every rollout of every problem."""
    return _levels(spark, d).agg(F.count("*").alias("n"), F.count("l2_dsr").alias("with_l2"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("dsr", "l1_dsr"), ("l2_dsr", "l2_dsr"), ("quality_reward", "l1_quality"), ("l2_quality", "l2_quality"))], F.round(X.correlation("dsr", "l2_dsr"), 6).alias("dsr_corr"), F.round(X.correlation("quality_reward", "l2_quality"), 6).alias("quality_corr"))


@query("with recursive " + S.QUALITY + _L2 + "select problem_id, count(*) as n from ll group by 1 having bool_and(l2_dsr is not null)")
def full_coverage(spark, d):
    """Problems of which every trace, in any rollout, has the second annotation."""
    return _levels(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.bool_and(F.col("l2_dsr").isNotNull()).alias("all_of_them")).filter("all_of_them").drop("all_of_them")


# Credit, distance and other views of liveness; samples and lookups.


@query(S.RECURSIVE + " select t.problem_id, t.rollout_id, t.trace_id, coalesce(sum(case when is_live then 1 when step_type in ('computation', 'derivation') then -1 else 0 end), 0)::bigint as credit from t left join ls using (rollout_id, trace_id) group by all")
def step_credit(spark, d):
    """Per trace: one for every live step, minus one for every dead computation or derivation."""
    p = T.parsed(spark, d)
    one = lambda s: F.when(F.array_contains("live", s["id"]), 1).when(s["step_type"].isin("computation", "derivation"), -1).otherwise(0)
    return T.unique(p.select(*T.KEYS, F.aggregate("steps", F.lit(0), lambda a, s: a + one(s)).cast("bigint").alias("credit")))


@query("with recursive " + S.GRAPH + """, dist(rollout_id, trace_id, step_id, k) as (
   select s.rollout_id, s.trace_id, s.step_id, 0 from s join n using (rollout_id, trace_id) where s.step_type = 'conclusion' or (not concluded and step_id = last_id)
   union select e.rollout_id, e.trace_id, e.src, x.k + 1 from dist x join e on e.rollout_id = x.rollout_id and e.trace_id = x.trace_id and e.dst = x.step_id),
  near as (select rollout_id, trace_id, step_id, min(k) as k from dist group by all)
  select t.problem_id, t.rollout_id, t.trace_id, round(coalesce(sum(power(0.5::double, k)), 0), 6) as weighted_liveness, coalesce(max(k), 0)::int as depth from t left join near using (rollout_id, trace_id) group by all""")
def weighted_liveness(spark, d):
    """Per trace: the sum of 0.5 to the distance of every live step from a conclusion, and the greatest distance."""
    p = T.parsed(spark, d)
    back = F.when(F.size("edges") > 0, F.reverse(F.sequence(F.lit(0), F.size("edges") - 1))).otherwise(F.array().cast("array<int>"))
    start = F.map_from_arrays("conclusions", F.transform("conclusions", lambda _: F.lit(0)))

    def grow(acc, i):
        used = F.element_at(F.col("edges"), i + 1)
        more = F.map_from_arrays(used, F.transform(used, lambda _: acc[i] + 1))
        return F.when(F.map_contains_key(acc, i), F.map_zip_with(acc, more, lambda _, a, b: F.least(a, b))).otherwise(acc)

    dist = F.map_values(F.aggregate(back, start, grow))
    p = T.unique(p.select(*T.KEYS, T.once(dist).alias("dist")))
    return p.select(*T.KEYS, F.round(F.aggregate("dist", F.lit(0.0), lambda a, k: a + F.pow(F.lit(0.5), k)), 6).alias("weighted_liveness"), F.coalesce(F.array_max("dist"), F.lit(0)).alias("depth"))


@query(_r(", fr as (select * from (" + _FRAGILE.replace(", pk as", "with pk as", 1) + ")) select kind, fragile, count(*) as n, sum(n_chars)::bigint as chars from fr group by all"))
def fragile_summary(spark, d):
    """What a cautious elimination would keep (fragile) and remove (robust), by kind."""
    return R.fragile(_records(spark, d).filter("size(rsteps) > 0")).groupBy("kind", "fragile").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(S.ROWS + f", c as (select problem_id, rollout_id, trace_id, is_correct, {_COUNTS} from t), x as (select is_correct, {_V} as v from c) select v > (select median(v) from x) as more, count(*) as n, round(avg(is_correct::int), 6) as accuracy from x group by 1")
def verification_median_split(spark, d):
    """Accuracy of traces that verify more than the median trace, and of the others."""
    t = T.traces(spark, d).withColumn("low", F.lower("solution"))
    x = T.unique(t.select(*T.KEYS, "is_correct", sum((F.regexp_count("low", F.lit(fixed.COUNTED[k])) for k in fixed.COUNTED_VERIFICATION), F.lit(0)).alias("v")))
    g = x.groupBy("v", "is_correct").agg(F.count("*").alias("n"))
    mid = g.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("mid"))
    return g.join(F.broadcast(mid)).groupBy((F.col("v") > F.col("mid")).alias("more")).agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("is_correct"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))


@query("select problem_id from (select distinct problem_id from problems) order by md5(problem_id || '42'), problem_id limit 25")
def hash_sample(spark, d):
    """A sample of problems that any engine draws alike."""
    p = table(spark, d, "problems").select("problem_id").distinct()
    return p.orderBy(F.md5(F.concat("problem_id", F.lit("42")).cast("binary")), "problem_id").limit(25)


@query(S.ROWS + ", a as (select problem_id, min(answer) as answer from problems where answer is not null group by 1) select t.problem_id, t.rollout_id, t.trace_id, coalesce(a.answer, t.ground_truth) as truth from t left join a using (problem_id)")
def ground_truth_lookup(spark, d):
    """Each trace's truth from the problem bank, or its own where the bank has none."""
    a = table(spark, d, "problems").filter("answer is not null").groupBy("problem_id").agg(F.min("answer").alias("bank"))
    return T.unique(T.traces(spark, d).select(*T.KEYS, "ground_truth")).join(a, "problem_id", "left").select(*T.KEYS, F.coalesce("bank", "ground_truth").alias("truth"))


@query(S.ROWS + f" select problem_id, rollout_id, trace_id, case when instr(solution, '</think>') > 0 then {S.trim(chr(115) + 'ubstr(solution, instr(solution, ' + chr(39) + '</think>' + chr(39) + ') + 8)')} else solution end as body, case when regexp_matches(solution, '(?s)<think>(.*?)</think>') then regexp_extract(solution, '(?s)<think>(.*?)</think>', 1) else solution end as thinking from t")
def think_texts(spark, d):
    """What follows the thinking block, and what stands in it."""
    return T.single(spark, d).select(*T.KEYS, text.reasoning_body(F.col("solution")).alias("body"), text.thinking(F.col("solution")).alias("thinking"))


_SCAFFOLD = ["explicit_verify", "wait", "rethink", "what_if", "alternatively", "examine"]


@query(S.ROWS + f", c as (select rollout_id, trace_id, is_correct, {_COUNTS} from t), w as (select b.trace_id as model, a.is_correct as ca, b.is_correct as cb, " + ", ".join(f"b.{k} - a.{k} as {k}" for k in _SCAFFOLD) + " from c a join c b on a.rollout_id = b.rollout_id and a.trace_id = 0 and b.trace_id > 0) select model, case when ca and cb then 'both' when ca then 'base_only' when cb then 'new_only' else 'neither' end as outcome, count(*) as n, " + ", ".join(f"round(avg({k}), 6) as {k}" for k in _SCAFFOLD) + " from w group by 1, 2")
def scaffold_diff(spark, d):
    """How much more often each later run uses each phrase than run 0, by who solved the problem."""
    t = T.traces(spark, d).withColumn("low", F.lower("solution"))
    c = T.unique(t.select(*T.KEYS, "is_correct", *[F.regexp_count("low", F.lit(fixed.COUNTED[k])).alias(k) for k in _SCAFFOLD]))
    a = c.filter("trace_id = 0").select("rollout_id", F.col("is_correct").alias("ca"), *[F.col(k).alias(f"a_{k}") for k in _SCAFFOLD])
    b = c.filter("trace_id > 0").select("rollout_id", F.col("trace_id").alias("model"), F.col("is_correct").alias("cb"), *_SCAFFOLD)
    outcome = F.when(F.col("ca") & F.col("cb"), "both").when(F.col("ca"), "base_only").when(F.col("cb"), "new_only").otherwise("neither")
    return a.join(b, "rollout_id").groupBy("model", outcome.alias("outcome")).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(k) - F.col(f"a_{k}")), 6).alias(k) for k in _SCAFFOLD])


@query(S.PAIRS + ", k as (select problem_text, pair_type, count(*) as n from pr group by all) select problem_text, count(*) as kinds, sum(n)::bigint as pairs from k group by 1 having count(*) > 1")
def problems_in_several_kinds(spark, d):
    """Prompts, told apart by their whole texts, that more than one kind of pair covers."""
    k = _pairs_once(spark, d).groupBy("problem_text", "pair_type").agg(F.count("*").alias("n"))
    return k.groupBy("problem_text").agg(F.count("*").alias("kinds"), F.sum("n").alias("pairs")).filter("kinds > 1")


@query(_r("select count(*) filter (dead_token_ratio > 0.05)::double / count(*) > 0.5 as wasteful, abs(avg(dsr) filter (is_correct) - avg(dsr) filter (not is_correct)) < 0.05 as independent, avg(vii) filter (verif > 0) > 0.3 as idle_verification, count(*) as n from fe"))
def verdicts(spark, d):
    """Three yes-or-no findings over all records."""
    f = _features(spark, d)
    right = F.col("is_correct")
    return f.agg((F.count_if(F.col("dead_token_ratio") > 0.05) / F.count("*") > 0.5).alias("wasteful"), (F.abs(F.avg(F.when(right, F.col("dsr"))) - F.avg(F.when(~right, F.col("dsr")))) < 0.05).alias("independent"), (F.avg(F.when(F.col("verif") > 0, F.col("vii"))) > 0.3).alias("idle_verification"), F.count("*").alias("n"))
