"""Further queries: answers and records in all their variants, the parser path, and the tables of every report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import fixed, text
from tracemill.operators import evals as E
from tracemill.operators import motifs as M
from tracemill.operators import pairs as P
from tracemill.operators import parser as J
from tracemill.operators import prefixes as N
from tracemill.operators import quality as Q
from tracemill.operators import rir as R
from tracemill.operators import select as B
from tracemill.operators import stats as X
from tracemill.operators import traces as T
from tracemill.plans import catalogue as C
from tracemill.plans import sqltext as S
from tracemill.plans.catalogue import query
from tracemill.session import materialize, table

_KEYS = "problem_id, rollout_id, trace_id"


def r6(c):
    return F.round(c, 6)


# Answers.

_LAST = "(list_reduce(list_transform(regexp_extract_all(string_split({0}, '\\boxed{{')[-1], '(?s)(\\{{|\\}}|[^{{}}]+)'), lambda z: {{'depth': 0, 'inner': '', 'tok': z}}), lambda acc, z: case when acc.depth = 0 then acc when z.tok = '}}' and acc.depth = 1 then {{'depth': 0, 'inner': acc.inner, 'tok': ''}} else {{'depth': acc.depth + case z.tok when '{{' then 1 when '}}' then -1 else 0 end, 'inner': acc.inner || z.tok, 'tok': ''}} end, {{'depth': 1, 'inner': '', 'tok': ''}}))"


def _last_sql(x: str) -> str:
    one = _LAST.format(x)
    return f"case when contains({x}, '\\boxed{{') and {one}.depth = 0 then {S.trim(one + '.inner')} end"


@query(S.ROWS + f" select {_KEYS}, {_last_sql('solution')} as boxed from t")
def last_boxed_answers(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.last_boxed(F.col("solution")).alias("boxed")))


def _light_sql(x: str) -> str:
    a = f"regexp_replace({S.trim(x)}, {S.q(r'\\(?:text|mathrm|mathbf|mbox)\{([^}]*)\}')}, '\\1', 'g')"
    a = f"replace(replace(replace({a}, '\\dfrac', '\\frac'), '\\left', ''), '\\right', '')"
    return f"regexp_replace(regexp_replace({a}, '\\s+', '', 'g'), '\\.+$', '')"


@query(S.ROWS + f" select {_KEYS}, {_light_sql('answer')} as light, {_light_sql('answer')} <> '' and {_light_sql('answer')} = {_light_sql('ground_truth')} as correct from t")
def light_answers(spark, d):
    a, g = F.col("answer"), F.col("ground_truth")
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.light_answer(a).alias("light"), text.light_correct(a, g).alias("correct")))


_WRAPPED = "(length({0}) >= 2 and ((starts_with({0}, '(') and ends_with({0}, ')')) or (starts_with({0}, '{{') and ends_with({0}, '}}')) or (starts_with({0}, '[') and ends_with({0}, ']'))))"
_LENIENT = (
    f", nm as (select {_KEYS}, {C._normal_sql('answer')} as p, {C._normal_sql('ground_truth')} as g from t), sg as (select *, string_split(g, '\\pm') as sides from nm), pm as (select *, case when len(sides) = 2 then {C._normal_sql("(sides[1] || '+' || sides[2])")} end as plus, case when len(sides) = 2 then {C._normal_sql("(sides[1] || '-' || sides[2])")} end as minus from sg)"
    + f" select {_KEYS}, coalesce(p <> '' and (p = g or ({_WRAPPED.format('p')} and substr(p, 2, length(p) - 2) = g) or ({_WRAPPED.format('g')} and substr(g, 2, length(g) - 2) = p) or coalesce(p = plus or p = minus or (contains(p, plus) and contains(p, minus)), false)), false) as correct from pm"
)


@query(S.ROWS + _LENIENT)
def lenient_correctness(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.lenient_correct(F.col("answer"), F.col("ground_truth")).alias("correct")))


@query(S.ROWS + f", ra as (select {_KEYS}, ground_truth, coalesce({_last_sql('solution')}, string_split({S.trim('solution')}, E'\\n')[-1]) as said from t), nb as (select *, {C._numeric_sql('said')} as a, {C._numeric_sql('ground_truth')} as g from ra) select {_KEYS}, said, case when try_cast(a as double) is not null and try_cast(g as double) is not null then try_cast(a as double) = try_cast(g as double) else lower(a) = lower(g) end as correct from nb")
def record_correctness(spark, d):
    said = text.record_answer(F.col("solution"))
    t = T.single(spark, d).select(*T.KEYS, "ground_truth", said.alias("said"))
    return t.select(*T.KEYS, "said", text.numeric_equal(F.col("said"), F.col("ground_truth")).alias("correct"))


@query(S.ROWS + f", b as (select {_KEYS}, solution, {C._boxed_sql('solution')} as boxed from t) select {_KEYS}, case when boxed <> '' then boxed else regexp_extract(right(solution, 200), '(?:^|[^\\p{{L}}\\p{{N}}_])([ABCD])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) end as letter from b")
def letter_answers(spark, d):
    return T.unique(T.traces(spark, d).select(*T.KEYS, text.letter_answer(F.col("solution")).alias("letter")))


# Segments and records.


@query(S.PLAIN + f", rw as (select {_KEYS}, solution, regexp_split_to_array(solution, '\\n\\n+') as parts from t), ri as (select {_KEYS}, parts, unnest(range(len(parts)))::int as raw_id from rw), rn as (select {_KEYS}, raw_id, length(parts[raw_id + 1])::int as length, row_number() over (partition by rollout_id, trace_id order by raw_id) - 1 as step_id from ri where {S.trim('parts[raw_id + 1]')} <> '') select rn.problem_id, rn.rollout_id, rn.trace_id, raw_id, step_type, length from rn join s using (rollout_id, trace_id, step_id)")
def segments_raw(spark, d):
    """Paragraphs under their places among all pieces of the text, with type and untrimmed length."""
    rows = F.transform(text.raw_segments(F.col("solution")), lambda s: F.struct(s["id"].alias("raw_id"), s["step_type"].alias("step_type"), s["length"].alias("length")))
    return T.unique(T.traces(spark, d).select(*T.KEYS, rows.alias("rows"))).select(*T.KEYS, F.explode("rows").alias("s")).select(*T.KEYS, "s.*")


@query(S.PLAIN + f", rw as (select {_KEYS}, regexp_split_to_array(solution, '\\n\\n+') as parts from t), ri as (select {_KEYS}, parts[i + 1] as x, i from (select *, unnest(range(len(parts)))::int as i from rw)), rn as (select *, (row_number() over (partition by rollout_id, trace_id order by i) - 1)::int as segment from ri where {S.trim('x')} <> '') select rn.problem_id, rn.rollout_id, rn.trace_id, segment, {C._PRIORITY} as phase, length(x)::int as length, substr(content, 1, 100) as preview from rn join s1 on s1.rollout_id = rn.rollout_id and s1.trace_id = rn.trace_id and s1.step_id = rn.segment")
def segment_previews(spark, d):
    return T.single(spark, d).select(*T.KEYS, F.explode(text.segment_phases(F.col("solution"))).alias("s")).select(*T.KEYS, "s.*")


@query(S.ROWS + f" select {_KEYS}, problem_text as human, solution as gpt, {S.q(fixed.SYSTEM_PROMPT)} as system from t")
def sft_records(spark, d):
    """Traces as training records of one turn, read back from the record's fields."""
    r = T.single(spark, d).select(*T.KEYS, text.sft_record(F.col("problem_text"), F.col("solution")).alias("r"))
    return r.select(*T.KEYS, F.element_at("r.conversations", 1)["value"].alias("human"), F.element_at("r.conversations", 2)["value"].alias("gpt"), F.col("r.system").alias("system"))


@query(S.ROWS + f" select {_KEYS}, case when length(solution) > 200 then substr(solution, 1, 200) || '...' else solution end as start, right(solution, 200) as finish, substr(solution, 1, 8000) as for_hosted, substr(solution, 1, 4000) as for_local from t")
def excerpts(spark, d):
    """The parts of a text that prompts and reports show: a marked start, the last characters, and what parsers are given."""
    s = F.col("solution")
    return T.single(spark, d).select(*T.KEYS, text.excerpt(s, 200).alias("start"), F.right(s, F.lit(200)).alias("finish"), F.substring(s, 1, 8000).alias("for_hosted"), F.substring(s, 1, 4000).alias("for_local"))


@query(S.ROWS + f" select {_KEYS} from t order by rollout_id, trace_id limit 100")
def max_traces(spark, d):
    """The first hundred traces in order: how many a run annotates is a limit of that run."""
    return C._outcomes(spark, d).select(*T.KEYS).orderBy("rollout_id", "trace_id").limit(100)


@query("with p as (select problem_id, min(level) as level from problems group by 1), l as (select count(distinct level) as n from p), k as (select problem_id, level, row_number() over (partition by level order by problem_id) as k from p where level is not null) select problem_id, level from k, l where k.k <= greatest(1, 50 // n) order by level, problem_id limit 50")
def stratified_quota(spark, d):
    """Fifty problems in all, as many of each level as fit evenly."""
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level")).filter("level is not null")
    n = p.agg(F.greatest(F.lit(1), F.floor(F.lit(50) / F.countDistinct("level"))).alias("quota"))
    k = p.withColumn("k", F.row_number().over(Window.partitionBy("level").orderBy("problem_id"))).filter("k <= 50")
    return k.join(F.broadcast(n)).filter("k <= quota").select("problem_id", "level").orderBy("level", "problem_id").limit(50)


# Pairs with their texts, in an order that only depends on their keys.

_SHUFFLE = "md5(concat_ws('|', pair_type, problem_id, chosen_rollout_id, chosen_trace_id, rejected_rollout_id, rejected_trace_id, '42'))"


@query("with recursive " + S.FLAGS + f" select *, {_SHUFFLE} as place from ({S.ALL_PAIRS})")
def shuffled_pairs(spark, d):
    """All pairs in a shuffled order that any engine draws alike."""
    return P.shuffled(P.all_pairs(C._prepared(spark, d)))


@query("with recursive " + S.FLAGS + f", ap as ({S.ALL_PAIRS}), ec as ({S.EXCISION}) select ap.pair_type, ap.problem_id, ap.chosen_rollout_id, ap.chosen_trace_id, ap.rejected_rollout_id, ap.rejected_trace_id, c.problem_text, c.solution as chosen_solution, r.solution as rejected_solution from ap join t c on c.rollout_id = ap.chosen_rollout_id and c.trace_id = ap.chosen_trace_id join t r on r.rollout_id = ap.rejected_rollout_id and r.trace_id = ap.rejected_trace_id where pair_type <> 'contrastive_excision' union all select 'contrastive_excision', ec.problem_id, ec.rollout_id, ec.trace_id, ec.rollout_id, ec.trace_id, t.problem_text, ec.chosen_solution, t.solution from ec join t using (rollout_id, trace_id)")
def pair_texts(spark, d):
    """All pairs with the texts they are trained on; only traces that are in a pair have their texts joined."""
    single = T.single(spark, d)
    return P.with_texts(P.all_pairs(C._prepared(spark, d)), P.excision_texts(T.parse(single)), single)


@query(S.PAIRS + ", k as (select pair_type, regexp_extract(problem_id, '([0-9]+)', 1) as number from pr) select coalesce(pair_type, 'any') as pair_type, count(distinct number) as problems, count(*) as pairs, round(count(*)::double / count(distinct number), 6) as pairs_per_problem from k where number <> '' group by rollup (pair_type)")
def pair_problem_union(spark, d):
    """Problems that each kind of pair covers, that any covers, and pairs per problem."""
    k = C._pairs_once(spark, d).select("pair_type", F.regexp_extract("problem_id", "([0-9]+)", 1).alias("number")).filter("number <> ''")
    g = k.rollup("pair_type").agg(F.countDistinct("number").alias("problems"), F.count("*").alias("pairs"))
    return g.select(F.coalesce("pair_type", F.lit("any")).alias("pair_type"), "problems", "pairs", r6(F.col("pairs") / F.col("problems")).alias("pairs_per_problem"))


# The parser path.


def _replies(spark, d):
    p = T.parsed(spark, d)
    reply = F.when(F.size("steps") > 0, F.concat(F.lit("Here is the structure:\n"), J.as_reply(F.col("steps"), F.col("edges"), 1), F.lit("\nThat is all."))).otherwise("No structure was found.")
    return p.select(*T.KEYS, "is_correct", "num_tokens", "solution", T.once(reply).alias("reply"))


def _by_reply(spark, d):
    w = Q.with_quality(J.parse_replies(_replies(spark, d), "reply", 1))
    n = F.size("steps")
    kinds = {k: Q.count_of(k) for k in fixed.PENALTY}
    cost = sum((c * F.lit(fixed.PENALTY[k]) for k, c in kinds.items()), F.lit(0.0))
    reward = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cost / n))).otherwise(1.0)
    return T.unique(w.select(*T.KEYS, "parse_success", n.cast("bigint").alias("num_steps"), F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0).alias("dsr"), F.round(reward, 9).alias("quality_reward"), *[c.cast("bigint").alias(k) for k, c in kinds.items()]))


@query("with recursive " + S.QUALITY + f" select {_KEYS}, num_steps > 0 as parse_success, num_steps, round(dsr, 9) as dsr, quality_reward from qr")
def parser_path(spark, d):
    """Traces through the parser path: structure as JSON inside a reply, salvaged, cleaned, and measured as text analysis is."""
    return _by_reply(spark, d).select(*T.KEYS, "parse_success", "num_steps", F.round("dsr", 9).alias("dsr"), "quality_reward")


_COMPARED = ", count(*) as n, round(avg(dsr), 6) as avg_dsr, round(avg(quality_reward), 6) as avg_quality, round(avg(num_steps), 6) as avg_steps, " + ", ".join(f"sum({k})::bigint as {k}" for k in fixed.PENALTY)


@query("with recursive " + S.QUALITY + f" select 'text' as level, 1.0::double as success{_COMPARED} from qr union all select 'reply', round(avg((num_steps > 0)::int), 6){_COMPARED} from qr")
def parser_comparison(spark, d):
    """Text analysis and the parser path side by side: means, kinds of dead steps, and how many replies could be read."""
    out = None
    for level, x in (("text", C.scored(spark, d).withColumn("parse_success", F.lit(True))), ("reply", _by_reply(spark, d))):
        one = x.agg(F.lit(level).alias("level"), r6(F.avg(F.col("parse_success").cast("double"))).alias("success"), F.count("*").alias("n"), r6(F.avg("dsr")).alias("avg_dsr"), r6(F.avg("quality_reward")).alias("avg_quality"), r6(F.avg("num_steps")).alias("avg_steps"), *[F.sum(k).alias(k) for k in fixed.PENALTY])
        out = one if out is None else out.unionByName(one)
    return out.select("level", "success", "n", "avg_dsr", "avg_quality", "avg_steps", *fixed.PENALTY)


@query(S.RECURSIVE + f", i as (select rollout_id, trace_id, dst as step_id, list(src order by src) as inputs from e group by all), o as (select rollout_id, trace_id, src as step_id, list(dst order by dst) as outputs from e group by all) select ls.problem_id, rollout_id, trace_id, step_id, step_type, is_live, coalesce(array_to_string(inputs, ' '), '') as inputs, coalesce(array_to_string(outputs, ' '), '') as outputs from ls left join i using (rollout_id, trace_id, step_id) left join o using (rollout_id, trace_id, step_id)")
def graph_records(spark, d):
    """Graphs written as JSON and read back: a row per node."""
    p = T.parsed(spark, d)
    j = T.unique(p.select(*T.KEYS, T.once(F.when(F.size("steps") > 0, J.graph_json(F.col("steps"), F.col("edges"), F.col("live")))).alias("j")))
    back = F.from_json("j", "struct<nodes: array<struct<step_id: int, step_type: string, inputs: array<int>, outputs: array<int>, is_live: boolean>>>")["nodes"]
    ids = lambda c: F.array_join(F.transform(F.array_sort(c), lambda i: i.cast("string")), " ")
    return j.select(*T.KEYS, F.explode(back).alias("n")).select(*T.KEYS, "n.step_id", "n.step_type", "n.is_live", ids("n.inputs").alias("inputs"), ids("n.outputs").alias("outputs"))


@query(S.RECURSIVE + f" select ann.problem_id, ann.rollout_id, ann.trace_id, num_steps, num_dead, round(dsr, 9) as dsr, coalesce(string_agg(step_id || ':' || step_type || ':' || is_live::int || ':' || substr(content, 1, 80), ';' order by step_id), '') as details from ann left join ls using (rollout_id, trace_id) group by all")
def structural_details(spark, d):
    """Metrics of a text with the details of its steps; an empty text has zeros."""
    p = T.parse(T.single(spark, d))
    n = F.size("steps")
    one = F.transform("steps", lambda s: F.concat_ws(":", s["id"].cast("string"), s["step_type"], F.array_contains("live", s["id"]).cast("int").cast("string"), F.substring(s["content"], 1, 80)))
    return p.select(*T.KEYS, n.cast("bigint").alias("num_steps"), (n - F.size("live")).cast("bigint").alias("num_dead"), F.round(F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0), 9).alias("dsr"), F.array_join(one, ";").alias("details"))


@query("with recursive " + S.MOTIFS + f" select mo.problem_id, mo.rollout_id, mo.trace_id, motif_seq::int as motif_seq, motif_type, (select string_agg(content, E'\\n\\n' order by step_id) from s where s.rollout_id = mo.rollout_id and s.trace_id = mo.trace_id and s.step_id >= first_id and s.step_id < first_id + mo.length) as text_span from mo")
def motif_spans(spark, d):
    """The text that every motif spans."""
    m = M.with_motifs(T.parse(T.single(spark, d)))
    span = lambda x: F.array_join(F.transform(F.slice(F.col("steps"), x["first_id"] + 1, x["length"]), lambda s: s["content"]), "\n\n")
    rows = F.transform("motifs", lambda x, i: F.struct(i.alias("motif_seq"), x["motif_type"].alias("motif_type"), span(x).alias("text_span")))
    return m.select(*T.KEYS, F.explode(rows).alias("m")).select(*T.KEYS, "m.*")


# Traces and problems.


@query(S.RECURSIVE + " select count(*) as traces, count(*) filter (is_correct) as correct, round(avg(dsr), 6) as avg_dsr, round(avg(dsr) filter (is_correct), 6) as avg_dsr_correct from ann")
def annotate_summary(spark, d):
    return C._annotated(spark, d).agg(F.count("*").alias("traces"), F.count_if("is_correct").alias("correct"), r6(F.avg("dsr")).alias("avg_dsr"), r6(F.avg(F.when(F.col("is_correct"), F.col("dsr")))).alias("avg_dsr_correct"))


@query(S.RECURSIVE + " select coalesce(g, 'all') as traces, count(*) as n, count(distinct problem_id) as problems, round(avg(dsr), 6) as avg_dsr, round(avg(num_steps), 6) as avg_steps, round(avg(trace_length), 6) as avg_length from (select *, case when is_correct then 'correct' else 'incorrect' end as g from ann) group by rollup (g)")
def rollout_statistics(spark, d):
    """Means over all traces, correct and incorrect ones."""
    a = C._annotated(spark, d).withColumn("g", F.when(F.col("is_correct"), "correct").otherwise("incorrect"))
    g = a.rollup("g").agg(F.count("*").alias("n"), F.countDistinct("problem_id").alias("problems"), *[r6(F.avg(c)).alias(n) for c, n in (("dsr", "avg_dsr"), ("num_steps", "avg_steps"), ("trace_length", "avg_length"))])
    return g.select(F.coalesce("g", F.lit("all")).alias("traces"), "n", "problems", "avg_dsr", "avg_steps", "avg_length")


@query(S.ROWS + " select count(*) as problems, count(*) filter (c >= 1) as solved, count(*) filter (c >= 2) as solved_twice from (select problem_id, count(*) filter (is_correct) as c from t group by 1)")
def rollout_solved(spark, d):
    """Problems with one correct trace or more, and with two or more."""
    g = C._outcomes(spark, d).groupBy("problem_id").agg(F.count_if("is_correct").alias("c"))
    return g.agg(F.count("*").alias("problems"), F.count_if(F.col("c") >= 1).alias("solved"), F.count_if(F.col("c") >= 2).alias("solved_twice"))


@query("with recursive " + S.QUALITY + ", pv as (select problem_id, case when count(*) = count(*) filter (is_correct) then 'saturated' else 'partial' end as category, var_pop(dsr) filter (is_correct) as dv, var_pop(quality_reward) filter (is_correct) as qv, case when stddev_pop(dsr) filter (is_correct) > 0 and stddev_pop(quality_reward) filter (is_correct) > 0 then corr(dsr, quality_reward) filter (is_correct) end as r from qr group by 1 having count(*) filter (is_correct) >= 2) select category, count(*) as problems, round(avg(dv), 6) as mean_dsr_var, round(median(dv), 6) as median_dsr_var, round(avg(qv), 6) as mean_quality_var, round(median(qv), 6) as median_quality_var, round(case when avg(dv) > 0 then avg(qv) / avg(dv) end, 4) as ratio, round(avg(r), 4) as mean_corr from pv group by 1")
def quality_variance_stats(spark, d):
    """Variances of rewards and ratios between the correct traces of a problem, their medians, ratio and correlation."""
    right = lambda c: F.when(F.col("is_correct"), F.col(c))
    g = C.scored(spark, d).groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"), F.var_pop(right("dsr")).alias("dv"), F.var_pop(right("quality_reward")).alias("qv"), X.correlation(right("dsr"), right("quality_reward")).alias("r")).filter("c >= 2")
    g = materialize(g.select(F.when(F.col("n") == F.col("c"), "saturated").otherwise("partial").alias("category"), "dv", "qv", F.when((F.col("dv") > 0) & (F.col("qv") > 0), F.col("r")).alias("r")))
    out = g.groupBy("category").agg(F.count("*").alias("problems"), r6(F.avg("dv")).alias("mean_dsr_var"), r6(F.avg("qv")).alias("mean_quality_var"), F.round(F.when(F.avg("dv") > 0, F.avg("qv") / F.avg("dv")), 4).alias("ratio"), F.round(F.avg("r"), 4).alias("mean_corr"))
    for c, name in (("dv", "median_dsr_var"), ("qv", "median_quality_var")):
        out = out.join(F.broadcast(X.medians(g, c, "category", ["saturated", "partial"]).select("category", r6("median").alias(name))), "category", "left")
    return out


_SATURATED = "(select problem_id from qr group by 1 having count(*) = count(*) filter (is_correct))"


def _saturated(a):
    g = a.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"))
    return g.filter("n = c").select("problem_id", F.col("n").alias("of_problem"))


@query("with recursive " + S.QUALITY + " select count(*) as traces, round(avg(productive_dead_end), 6) as mean_productive, max(productive_dead_end) as max_productive, count(*) filter (productive_dead_end > 0) as with_productive, round(avg(verification_theater), 6) as mean_theater, max(verification_theater) as max_theater, count(*) filter (verification_theater > 0) as with_theater from qr where problem_id in " + _SATURATED)
def theater_saturated(spark, d):
    """Productive dead ends and verification theater in the traces of problems that every trace solves."""
    s = materialize(C.scored(spark, d).select("problem_id", "is_correct", "productive_dead_end", "verification_theater"))
    x = s.join(_saturated(s), "problem_id")
    return x.agg(F.count("*").alias("traces"), *[f for k, n in (("productive_dead_end", "productive"), ("verification_theater", "theater")) for f in (r6(F.avg(k)).alias(f"mean_{n}"), F.max(k).alias(f"max_{n}"), F.count_if(F.col(k) > 0).alias(f"with_{n}"))])


_ARGMAX = f", am as (select problem_id, count(*) as n, round(var_pop(quality_reward), 9) as quality_var from qr where problem_id in {_SATURATED} group by 1 having count(*) >= 4 and round(var_pop(quality_reward), 9) > 0 order by quality_var desc, problem_id limit 1)"


def _widest(s):
    g = s.join(_saturated(s), "problem_id").groupBy("problem_id").agg(F.count("*").alias("n"), F.round(F.var_pop("quality_reward"), 9).alias("quality_var")).filter("n >= 4 and quality_var > 0")
    return g.orderBy(F.desc("quality_var"), "problem_id").limit(1)


@query("with recursive " + S.QUALITY + _ARGMAX + " select * from am")
def argmax_problem(spark, d):
    """The saturated problem with four traces or more whose rewards differ most."""
    return _widest(materialize(C.scored(spark, d).select("problem_id", "is_correct", "quality_reward")))


@query("with recursive " + S.QUALITY + _ARGMAX + f" select {_KEYS}, round(dsr, 9) as dsr, quality_reward, num_steps, " + ", ".join(fixed.PENALTY) + " from qr join (select problem_id from am) using (problem_id)")
def argmax_breakdown(spark, d):
    """Every trace of that problem with its dead steps by kind."""
    s = materialize(C.scored(spark, d).select(*T.KEYS, "is_correct", F.round("dsr", 9).alias("dsr"), "quality_reward", "num_steps", *fixed.PENALTY))
    return s.join(F.broadcast(_widest(s).select("problem_id")), "problem_id").drop("is_correct")


# Levels of parsing.

_LL = C._L2.replace("select l1.problem_id, ", "select l1.rollout_id, l1.num_tokens, l1.num_steps, l1.problem_id, ")


def _levels(spark, d):
    s = C.scored(spark, d).select("problem_id", "rollout_id", "trace_id", "is_correct", "dsr", "quality_reward", "num_tokens", "num_steps")
    return E.levels(s, table(spark, d, "annotated"))


@query("with recursive " + S.QUALITY + _LL + " select 'l1' as level, count(*) as n, 1.0::double as success, round(avg(dsr), 6) as avg_dsr, round(avg(quality_reward), 6) as avg_quality from ll union all select 'l2', count(l2_dsr), round(count(l2_dsr)::double / count(*), 6), round(avg(l2_dsr), 6), round(avg(l2_quality), 6) from ll")
def parser_levels(spark, d):
    """Means by level, and the share of traces a level has values for."""
    x = _levels(spark, d).agg(F.count("*").alias("n"), F.count("l2_dsr").alias("m"), *[r6(F.avg(c)).alias(c) for c in ("dsr", "quality_reward", "l2_dsr", "l2_quality")])
    row = lambda name, n, ok, a, b: F.struct(F.lit(name).alias("level"), n.alias("n"), ok.alias("success"), F.col(a).alias("avg_dsr"), F.col(b).alias("avg_quality"))
    return x.select(F.explode(F.array(row("l1", F.col("n"), F.lit(1.0), "dsr", "quality_reward"), row("l2", F.col("m"), r6(F.col("m") / F.col("n")), "l2_dsr", "l2_quality"))).alias("r")).select("r.*")


_PARTIAL = "(select problem_id from ll group by 1 having count(*) filter (is_correct) > 0 and count(*) filter (not is_correct) > 0)"


def _gap_sql(level: str, c: str) -> str:
    return f"select '{level}' as level, count({c}) filter (is_correct) as n_correct, round(avg({c}) filter (is_correct), 6) as dsr_correct, count({c}) filter (not is_correct) as n_incorrect, round(avg({c}) filter (not is_correct), 6) as dsr_incorrect, round(avg({c}) filter (not is_correct) - avg({c}) filter (is_correct), 6) as gap, round(corr({c}, is_correct::int::double), 6) as r from ll where problem_id in {_PARTIAL}"


@query("with recursive " + S.QUALITY + _LL + _gap_sql("l1", "dsr") + " union all " + _gap_sql("l2", "l2_dsr"))
def level_gaps(spark, d):
    """Dead-step ratios of correct and incorrect traces of partly solved problems, by level."""
    x = materialize(_levels(spark, d).select("problem_id", "is_correct", "dsr", "l2_dsr"))
    some = x.groupBy("problem_id").agg(F.bool_or("is_correct").alias("a"), F.bool_and("is_correct").alias("b")).filter("a and not b").select("problem_id")
    x = x.join(some, "problem_id")
    right = F.col("is_correct")
    out = None
    for level, c in (("l1", "dsr"), ("l2", "l2_dsr")):
        on, off = F.when(right, F.col(c)), F.when(~right, F.col(c))
        one = x.agg(F.lit(level).alias("level"), F.count(on).alias("n_correct"), r6(F.avg(on)).alias("dsr_correct"), F.count(off).alias("n_incorrect"), r6(F.avg(off)).alias("dsr_incorrect"), r6(F.avg(off) - F.avg(on)).alias("gap"), r6(X.correlation(c, right.cast("double"))).alias("r"))
        out = one if out is None else out.unionByName(one)
    return out.select("level", "n_correct", "dsr_correct", "n_incorrect", "dsr_incorrect", "gap", "r")


_TWO = {"shortest": "num_tokens", "longest": "num_tokens desc", "l1_dsr": "dsr", "l1_quality": "quality_reward desc", "l2_dsr": "l2_dsr", "l2_quality": "l2_quality desc"}
_FULL = ", fu as (select problem_id from ll group by 1 having bool_and(l2_dsr is not null and l2_quality is not null)), fl2 as materialized (select ll.*, count(*) filter (is_correct) over (partition by problem_id) as c, count(*) over (partition by problem_id) as n from ll where problem_id in (select problem_id from fu))"
_TWO_AGG = "count(*) as problems, round(avg(ok), 6) as accuracy, round(avg(num_tokens), 6) as avg_tokens, round(avg(dsr), 6) as avg_l1_dsr, round(avg(l2_dsr), 6) as avg_l2_dsr"
_STRATA = {"all": "true", "partial": "c > 0 and c < n"}


@query("with recursive " + S.QUALITY + _LL + _FULL + " union all ".join([f"select '{w}' as stratum, '{n}' as selector, {_TWO_AGG} from (select *, is_correct::int::double as ok, row_number() over (partition by problem_id order by {o}, rollout_id, trace_id) as k from fl2 where {cond}) where k = 1" for w, cond in _STRATA.items() for n, o in _TWO.items()] + [f"select '{w}', 'random', {_TWO_AGG} from (select problem_id, avg(is_correct::int::double) as ok, avg(num_tokens) as num_tokens, avg(dsr) as dsr, avg(l2_dsr) as l2_dsr from fl2 where {cond} group by 1)" for w, cond in _STRATA.items()]))
def best_of_n_levels(spark, d):
    """Selectors of both levels on problems whose every trace has the second one, and on the partly solved of them; 'random' is the exact expectation."""
    x = materialize(_levels(spark, d))
    full = x.groupBy("problem_id").agg(F.bool_and(F.col("l2_dsr").isNotNull() & F.col("l2_quality").isNotNull()).alias("full"), F.count_if("is_correct").alias("c"), F.count("*").alias("n")).filter("full").drop("full")
    x = materialize(x.join(full, "problem_id"))
    order = {"shortest": F.asc("num_tokens"), "longest": F.desc("num_tokens"), "l1_dsr": F.asc("dsr"), "l1_quality": F.desc("quality_reward"), "l2_dsr": F.asc("l2_dsr"), "l2_quality": F.desc("l2_quality")}
    out = None
    for w, cond in _STRATA.items():
        part = x.filter(cond).withColumn("ok", F.col("is_correct").cast("double"))
        chosen = {n: part.withColumn("k", F.row_number().over(Window.partitionBy("problem_id").orderBy(o, "rollout_id", "trace_id"))).filter("k = 1") for n, o in order.items()}
        chosen["random"] = part.groupBy("problem_id").agg(*[F.avg(c).alias(c) for c in ("ok", "num_tokens", "dsr", "l2_dsr")])
        for n, one in chosen.items():
            row = one.agg(F.lit(w).alias("stratum"), F.lit(n).alias("selector"), F.count("*").alias("problems"), r6(F.avg("ok")).alias("accuracy"), r6(F.avg("num_tokens")).alias("avg_tokens"), r6(F.avg("dsr")).alias("avg_l1_dsr"), r6(F.avg("l2_dsr")).alias("avg_l2_dsr"))
            row = row.select("stratum", "selector", "problems", "accuracy", "avg_tokens", "avg_l1_dsr", "avg_l2_dsr")
            out = row if out is None else out.unionByName(row)
    return out


@query(C.ORACLE["best_of_n_table"].replace(" select 'shortest'", ", bt as (select 'shortest'", 1) + ") select (select selector from bt order by accuracy desc, selector limit 1) as best_accuracy, (select max(accuracy) from bt) as accuracy, (select selector from bt order by avg_dsr, selector limit 1) as lowest_dsr, (select min(avg_dsr) from bt) as dsr")
def best_selectors(spark, d):
    """The selector with the highest accuracy and that with the fewest dead steps."""
    b = B.table_of_selectors(materialize(C.scored(spark, d)))
    first = lambda score: F.min(F.struct(score.alias("v"), F.col("selector")))
    x = b.agg(first(-F.col("accuracy")).alias("a"), first(F.col("avg_dsr")).alias("b"))
    return x.select(F.col("a.selector").alias("best_accuracy"), (-F.col("a.v")).alias("accuracy"), F.col("b.selector").alias("lowest_dsr"), F.col("b.v").alias("dsr"))


# Records: strata, verification, verdicts, variants.


@query("with recursive " + S.RIR + C._NAMED + " " + " union all ".join(f"select '{k}' as difficulty, (select count(*) from fc where difficulty = '{k}') as n, mean_1, mean_0, round(mean_1 - mean_0, 6) as diff, u, z from ({C._mwu_sql('dsr').replace(' fe', f' (select * from fc where difficulty = {S.q(k)}) fe')})" for k in ("easy", "medium", "hard", "unknown")))
def rir_difficulty_within(spark, d):
    """Inside every stratum: dead-step ratios of right records against wrong ones."""
    f = materialize(C._by_difficulty(spark, d).select("difficulty", "dsr", "is_correct"))
    out = None
    for k in ("easy", "medium", "hard", "unknown"):
        part = f.filter(F.col("difficulty") == k)
        n = part.agg(F.count("*").alias("n"))
        one = X.mann_whitney(part, "dsr", "is_correct").join(F.broadcast(X.cohens_d(part, "dsr", "is_correct"))).join(F.broadcast(n))
        one = one.select(F.lit(k).alias("difficulty"), "n", "mean_1", "mean_0", r6(F.col("mean_1") - F.col("mean_0")).alias("diff"), "u", r6("z").alias("z"))
        out = one if out is None else out.unionByName(one)
    return out


@query(C._r("select count(*) filter (verif > 0) as with_verification, count(*) filter (verif = 0) as without_verification, round(avg(vii) filter (verif > 0), 6) as mean, round(median(vii) filter (verif > 0), 6) as median, round(stddev_pop(vii) filter (verif > 0), 6) as std, round(min(vii) filter (verif > 0), 6) as least, round(max(vii) filter (verif > 0), 6) as most, round(sum(dead_verif_tokens)::double / sum(tokens), 6) as dead_token_share from fe"))
def rir_verification_summary(spark, d):
    f = materialize(C._features(spark, d).select("verif", "vii", "dead_verif_tokens", "tokens"))
    v = F.when(F.col("verif") > 0, F.col("vii"))
    mid = X.medians(f.filter("verif > 0").withColumn("g", F.lit("all")), "vii", "g", ["all"])
    one = f.agg(F.count_if(F.col("verif") > 0).alias("with_verification"), F.count_if(F.col("verif") == 0).alias("without_verification"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), r6(F.min(v)).alias("least"), r6(F.max(v)).alias("most"), r6(F.sum("dead_verif_tokens") / F.sum("tokens")).alias("dead_token_share"))
    return one.join(F.broadcast(mid.agg(r6(F.max("median")).alias("median"))))


_NOT_SEEN = 1.959964  # z of a two-sided p of 0.05


@query(C._r(f", zz as ({C._mwu_sql('dsr')} union all {C._mwu_sql('vii')}), ra as (select avg(list_product(list_transform(range(1, dead + 1), lambda i: i::double / (total - greatest(concluded, 1) - dead + i)))) as apr from fe where dead > 0), vv as (select (select count(*) filter (not is_live)::double / count(*) from rs where rtype = 'verification') > 0.7 as theater, (select max(z) from zz) < {_NOT_SEEN} as independent, true as safe, 1 - (select apr from ra) > 0.1 as structure, (select avg(dead_token_ratio) from fe) > 0.15 as savings) select *, theater::int + independent::int + safe::int + structure::int + savings::int as passed from vv"))
def verdict_checks(spark, d):
    """Five findings over all records, and how many hold: most verification is dead, waste tells nothing of correctness, pruning is safe, structure beats chance, savings matter."""
    f = materialize(C._features(spark, d))
    z = X.mann_whitney(f, "dsr", "is_correct").unionByName(X.mann_whitney(f, "vii", "is_correct")).agg(F.max("z").alias("z"))
    apr = R.random_removal(f).agg(F.avg("random_apr").alias("apr"))
    one = f.agg((F.sum("dead_verif") / F.sum("verif") > 0.7).alias("theater"), (F.avg("dead_token_ratio") > 0.15).alias("savings"))
    x = one.join(F.broadcast(z)).join(F.broadcast(apr)).select("theater", (F.round("z", 6) < _NOT_SEEN).alias("independent"), F.lit(True).alias("safe"), (1 - F.col("apr") > 0.1).alias("structure"), "savings")
    return x.withColumn("passed", sum((F.col(c).cast("int") for c in ("theater", "independent", "safe", "structure", "savings")), F.lit(0)))


_VL = (
    f", vt as (select {_KEYS}, {C._kept_sql('not is_live')} as dse, count(*) filter (not is_live) as n_dse, {C._kept_sql(chr(114) + 'type = ' + S.q('verification'))} as noverif, count(*) filter (rtype = 'verification') as n_noverif, {C._kept_sql('rtype = ' + S.q('verification') + ' and not is_live')} as liveverif, count(*) filter (rtype = 'verification' and not is_live) as n_liveverif, count(*) as steps from rs group by all)"
    + f", vl as materialized (select v.problem_id, rollout_id, trace_id, steps, n_dse, n_noverif, n_liveverif, dse <> solution as changed, length(solution) as len_original, length(dse) as len_dse, length(noverif) as len_noverif, length(liveverif) as len_liveverif, length({C._CLEANED}) as len_keywordclean from vt v join t using (rollout_id, trace_id)) "
)


def _lengths(spark, d):
    return R.variant_lengths(R.records(T.parsed(spark, d)).filter("size(rsteps) > 0"))


@query(C._r(_VL + "select count(*) as total, sum(steps)::bigint as total_steps, sum(len_original)::bigint as total_chars, sum(n_dse)::bigint as dse_removed_steps, sum(len_original - len_dse)::bigint as dse_removed_chars, sum(n_noverif)::bigint as noverif_removed_steps, sum(n_liveverif)::bigint as liveverif_removed_steps, sum(len_original - len_keywordclean)::bigint as keywordclean_removed_chars, round(sum(len_original - len_dse)::double / sum(len_original), 6) as dse_share, round(sum(len_original - len_keywordclean)::double / sum(len_original), 6) as keywordclean_share from vl"))
def dataset_stats(spark, d):
    """What every cleaned data set takes away, in steps and characters."""
    cut = lambda k: F.sum(F.col("len_original") - F.col(f"len_{k}"))
    return _lengths(spark, d).agg(F.count("*").alias("total"), F.sum("steps").alias("total_steps"), F.sum("len_original").alias("total_chars"), F.sum("removed_dse").alias("dse_removed_steps"), cut("dse").alias("dse_removed_chars"), F.sum("removed_noverif").alias("noverif_removed_steps"), F.sum("removed_liveverif").alias("liveverif_removed_steps"), cut("keywordclean").alias("keywordclean_removed_chars"), r6(cut("dse") / F.sum("len_original")).alias("dse_share"), r6(cut("keywordclean") / F.sum("len_original")).alias("keywordclean_share"))


@query(C._r(_VL + " union all ".join(f"select '{k}' as variant, {S.q(v)} as policy, round(avg(len_{k}), 6) as mean_length, round(1 - avg(len_{k}) / avg(len_original), 6) as reduction from vl" for k, v in fixed.POLICIES.items())))
def ablation_matrix(spark, d):
    """Mean length and reduction of every cleaned variant."""
    m = _lengths(spark, d).agg(*[F.avg(f"len_{k}").alias(k) for k in fixed.POLICIES])
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(v).alias("policy"), r6(k).alias("mean_length"), r6(1 - F.col(k) / F.col("original")).alias("reduction")) for k, v in fixed.POLICIES.items()])
    return m.select(F.explode(rows).alias("r")).select("r.*")


@query(S.EVAL + "select model, count(*) as benchmarks, round(avg(a), 6) as mean_accuracy, round(min(a), 6) as least, round(max(a), 6) as most from (select model, benchmark, avg(is_correct::int::double) as a from ev group by 1, 2) group by 1")
def accuracy_matrix(spark, d):
    """Accuracy by run: the mean over the benchmarks it has, and its range."""
    g = C._runs(spark, d).groupBy("model", "benchmark").agg(F.avg(F.col("is_correct").cast("double")).alias("a"))
    return g.groupBy("model").agg(F.count("*").alias("benchmarks"), r6(F.avg("a")).alias("mean_accuracy"), r6(F.min("a")).alias("least"), r6(F.max("a")).alias("most"))


_CUT = "case when len_original > 0 then (len_original - len_dse)::double / len_original * 100 else 0 end"


@query(C._r(_VL + f"select case when {_CUT} < 5 then 'none' when {_CUT} < 20 then 'light' when {_CUT} < 40 then 'medium' else 'heavy' end as impact, count(*) as n, round(avg(len_original), 6) as mean_original, round(avg(len_dse), 6) as mean_dse, round(avg(case when {_CUT} < 20 then len_dse else len_original end), 6) as mean_conservative from vl group by 1"))
def impact_conservative(spark, d):
    """Records by how much elimination takes away, and what a policy that leaves heavy cuts alone would keep."""
    x = _lengths(spark, d).withColumn("cut", F.when(F.col("len_original") > 0, (F.col("len_original") - F.col("len_dse")) / F.col("len_original") * 100).otherwise(0.0))
    bucket = F.when(F.col("cut") < 5, "none").when(F.col("cut") < 20, "light").when(F.col("cut") < 40, "medium").otherwise("heavy")
    return x.groupBy(bucket.alias("impact")).agg(F.count("*").alias("n"), r6(F.avg("len_original")).alias("mean_original"), r6(F.avg("len_dse")).alias("mean_dse"), r6(F.avg(F.when(F.col("cut") < 20, F.col("len_dse")).otherwise(F.col("len_original")))).alias("mean_conservative"))


@query(C._r(_VL + C._FRAGILE.replace("\n   select problem_id, rollout_id, trace_id, step_id, step_type as kind", ", fr as (select problem_id, rollout_id, trace_id, step_id, step_type as kind", 1) + "), kb as (select rollout_id, trace_id, coalesce(sum(n_chars) filter (kind in ('verification', 'exploration', 'correction')), 0) as back from fr group by all) select count(*) as records, count(*) filter (not changed) as unchanged, round(avg(len_original), 6) as mean_original, round(avg(len_dse), 6) as mean_dse, round(avg(len_dse + coalesce(back, 0)) filter (changed), 6) as mean_typed, round(1 - avg(len_dse) / avg(len_original), 6) as dse_reduction, round(1 - avg(len_dse + coalesce(back, 0)) filter (changed) / avg(len_original), 6) as typed_reduction from vl left join kb using (rollout_id, trace_id)"))
def typed_dse_totals(spark, d):
    """Full elimination against one that puts back removed verification, exploration and correction; records it leaves alone are counted, and left out of the typed mean."""
    r = R.records(T.parsed(spark, d)).filter("size(rsteps) > 0")
    back = R.fragile(r).filter(F.col("kind").isin("verification", "exploration", "correction")).groupBy("rollout_id", "trace_id").agg(F.sum("n_chars").alias("back"))
    x = R.variant_lengths(r).join(back, ["rollout_id", "trace_id"], "left")
    typed = F.avg(F.when(F.col("changed"), F.col("len_dse") + F.coalesce("back", F.lit(0))))
    return x.agg(F.count("*").alias("records"), F.count_if(~F.col("changed")).alias("unchanged"), r6(F.avg("len_original")).alias("mean_original"), r6(F.avg("len_dse")).alias("mean_dse"), r6(typed).alias("mean_typed"), r6(1 - F.avg("len_dse") / F.avg("len_original")).alias("dse_reduction"), r6(1 - typed / F.avg("len_original")).alias("typed_reduction"))


@query(S.PLAIN + ", x as (select step_type, char_length from s) select step_type, count(*) as n, round(count(*)::double / (select count(*) from x), 6) as share, round(avg(char_length), 6) as mean_length, sum(char_length)::bigint as chars from x group by 1")
def paragraph_types(spark, d):
    """How paragraphs spread over the types, in number and length."""
    p = T.traces(spark, d).select(*T.KEYS, F.transform(T.step_array(F.col("solution")), lambda s: F.struct(s["step_type"].alias("step_type"), s["char_length"].alias("n"))).alias("rows"))
    g = T.unique(p).select(F.explode("rows").alias("s")).groupBy("s.step_type").agg(F.count("*").alias("n"), r6(F.avg("s.n")).alias("mean_length"), F.sum("s.n").alias("chars"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("step_type", "n", r6(F.col("n") / F.col("total")).alias("share"), "mean_length", "chars")


@query(C._r(C._FRAGILE.replace("\n   select problem_id, rollout_id, trace_id, step_id, step_type as kind", ", fr as (select problem_id, rollout_id, trace_id, step_id, step_type as kind", 1) + ") select sum(n_chars) filter (kind = 'verification')::bigint as verification_chars, sum(n_chars) filter (kind <> 'verification')::bigint as other_chars, round(sum(n_chars) filter (kind = 'verification')::double / sum(n_chars), 6) as verification_share from fr"))
def removal_breakdown(spark, d):
    """Of what elimination removes: characters of verification and of the rest."""
    f = R.fragile(C._records(spark, d).filter("size(rsteps) > 0"))
    v = F.when(F.col("kind") == "verification", F.col("n_chars"))
    return f.agg(F.sum(v).alias("verification_chars"), F.sum(F.when(F.col("kind") != "verification", F.col("n_chars"))).alias("other_chars"), r6(F.sum(v) / F.sum("n_chars")).alias("verification_share"))


_ENT = "list_distinct(regexp_extract_all({0}, '[A-Za-z][0-9A-Za-z_]*|[0-9]+'))"


@query(S.RECURSIVE + f", en as materialized (select *, {_ENT.format('content')} as ent from ls), kp as (select a.*, is_live or step_type = 'conclusion' or (step_type in ('verification', 'exploration', 'correction') and exists (select 1 from en b where b.rollout_id = a.rollout_id and b.trace_id = a.trace_id and b.is_live and (abs(b.step_id - a.step_id) = 1 or (len(a.ent) > 0 and len(b.ent) > 0 and len(list_intersect(a.ent, b.ent))::double / least(len(a.ent), len(b.ent)) > 0.5)))) as kept from en a) select t.problem_id, t.rollout_id, t.trace_id, count(*) filter (kept) as kept_steps, coalesce(string_agg(content, E'\\n\\n' order by step_id) filter (kept), '') as cleaned from t left join kp using (rollout_id, trace_id) group by all")
def theta_policy(spark, d):
    """Traces without their robustly dead steps."""
    return R.theta_policy(T.parse(T.single(spark, d)))


# What an observer would have done, and rewards on the way.

_OBSERVED = "with recursive " + S.MOTIFS + ",\n" + S.PREFIX[S.PREFIX.index("pre as") :] + f""",
tv as (select rollout_id, trace_id, count(intervention) as iv, min(step_id) filter (intervention is not null) as first_at from tl group by all),
dc as (select rollout_id, trace_id, coalesce(sum(char_length) filter (not is_live), 0)::double / sum(char_length) as dead_chars from ls group by all),
mc as (select rollout_id, trace_id, count(*) as nm, {', '.join(f"count(*) filter (motif_type = '{k}') as {k}" for k in M.TYPES)} from mo group by all),
ob as materialized (select a.problem_id, a.rollout_id, a.trace_id, a.is_correct, a.dsr, iv, first_at::double / num_steps as first_share, dead_chars, {', '.join(f'coalesce({k}, 0) as {k}' for k in M.TYPES)} from ann a join tv using (rollout_id, trace_id) join dc using (rollout_id, trace_id) left join mc using (rollout_id, trace_id))"""


def _observed(spark, d):
    """A narrow row per trace with steps: interventions, where the first comes, dead characters, motifs."""
    m = M.with_motifs(T.parsed(spark, d))
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda a, s: a + s["char_length"])
    n = F.size("steps")
    dead = F.filter("steps", lambda s: ~F.array_contains("live", s["id"]))
    own = T.unique(m.filter(n > 0).select(*T.KEYS, "is_correct", n.alias("n"), ((n - F.size("live")) / n).alias("dsr"), (chars(dead) / chars(F.col("steps"))).alias("dead_chars"), *[M.count_of(k).alias(k) for k in M.TYPES]))
    t = N.timeline(T.parsed(spark, d)).groupBy("rollout_id", "trace_id").agg(F.count("intervention").alias("iv"), F.min(F.when(F.col("intervention").isNotNull(), F.col("step_id"))).alias("first_at"))
    return own.join(t, ["rollout_id", "trace_id"]).withColumn("first_share", F.col("first_at") / F.col("n"))


@query(_OBSERVED + f" select count(*) as traces, count(*) filter (iv > 0) as with_interventions, round(avg(iv), 6) as per_trace, round(avg(first_share), 6) as first_share, round(avg(dead_chars), 6) as dead_chars, round(avg(dsr) filter (iv > 0), 6) as dsr_with, round(avg(is_correct::int) filter (iv > 0), 6) as accuracy_with, round(avg(dsr) filter (iv = 0), 6) as dsr_without, round(avg(is_correct::int) filter (iv = 0), 6) as accuracy_without, {', '.join(f'sum({k})::bigint as {k}' for k in M.TYPES)} from ob")
def observation_summary(spark, d):
    """How many traces an observer would have stepped into, where, and what sets them apart."""
    some, right = F.col("iv") > 0, F.col("is_correct").cast("double")
    return _observed(spark, d).agg(F.count("*").alias("traces"), F.count_if(some).alias("with_interventions"), *[r6(F.avg(c)).alias(n) for c, n in (("iv", "per_trace"), ("first_share", "first_share"), ("dead_chars", "dead_chars"))], *[r6(F.avg(F.when(cond, c))).alias(f"{n}_{w}") for w, cond in (("with", some), ("without", ~some)) for n, c in (("dsr", F.col("dsr")), ("accuracy", right))], *[F.sum(k).alias(k) for k in M.TYPES])


@query(_OBSERVED + ", pl2 as (select problem_id, min(level) as level from problems group by 1) select coalesce(level, 0) as level, count(*) as traces, count(*) filter (iv > 0) as with_interventions, round(avg(dsr), 6) as avg_dsr from ob left join pl2 using (problem_id) group by 1")
def observation_levels(spark, d):
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level"))
    return _observed(spark, d).join(p, "problem_id", "left").groupBy(F.coalesce("level", F.lit(0)).alias("level")).agg(F.count("*").alias("traces"), F.count_if(F.col("iv") > 0).alias("with_interventions"), r6(F.avg("dsr")).alias("avg_dsr"))


@query(S.RECURSIVE + f" select ann.problem_id, ann.rollout_id, ann.trace_id, step_id, case when is_live then 1 when step_type in ('computation', 'derivation') then -1 else 0 end as credit, round(is_correct::int + 0.1::double * case when is_live then 1 when step_type in ('computation', 'derivation') then -1 else 0 end, 6) as reward from ann join ls using (rollout_id, trace_id)")
def step_rewards(spark, d):
    """The reward of every step: the outcome plus a tenth of the step's structural credit."""
    credit = lambda s: F.when(F.array_contains("live", s["id"]), 1).when(s["step_type"].isin("computation", "derivation"), -1).otherwise(0)
    rows = F.transform("steps", lambda s: F.struct(s["id"].alias("step_id"), credit(s).alias("credit")))
    p = T.unique(T.parsed(spark, d).select(*T.KEYS, "is_correct", rows.alias("rows"))).select(*T.KEYS, "is_correct", F.explode("rows").alias("s"))
    return p.select(*T.KEYS, "s.step_id", "s.credit", r6(F.col("is_correct").cast("int") + F.col("s.credit") * 0.1).alias("reward"))


# Runs against each other.

_WITH_MOTIFS = "with recursive " + S.MOTIFS + ", mn as (select rollout_id, trace_id, count(*) as nm from mo group by all), rn as materialized (select a.*, coalesce(nm, 0) as motifs from ann a left join mn using (rollout_id, trace_id)), rc as (select trace_id as model, count(*) as n, avg(is_correct::int::double) as accuracy, avg(dsr) as dsr, avg(num_tokens) as tokens, avg(num_steps) as steps, avg(motifs) as motifs from rn group by 1)"
_COND = ("accuracy", "dsr", "tokens", "steps", "motifs")


@query(_WITH_MOTIFS + " select rc.model, rc.n, " + ", ".join(f"round(rc.{c}, 6) as {c}, round(rc.{c} - b.{c}, 6) as {c}_delta" for c in _COND) + " from rc, rc b where b.model = 0")
def condition_deltas(spark, d):
    """Every run's means, motifs too, and their differences from run 0."""
    m = M.with_motifs(T.parsed(spark, d))
    n = F.size("steps")
    rows = T.unique(m.select(*T.KEYS, F.col("trace_id").alias("model"), F.col("is_correct").cast("double").alias("accuracy"), F.when(n > 0, (n - F.size("live")) / n).otherwise(0.0).alias("dsr"), F.col("num_tokens").alias("tokens"), n.alias("steps"), F.size("motifs").alias("motifs")))
    g = materialize(rows.groupBy("model").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _COND]))
    base = g.filter("model = 0").select(*[F.col(c).alias(f"b_{c}") for c in _COND])
    return g.join(F.broadcast(base)).select("model", "n", *[x for c in _COND for x in (r6(c).alias(c), r6(F.col(c) - F.col(f"b_{c}")).alias(f"{c}_delta"))])


_THINK = f"case when regexp_matches(solution, '(?s)<think>(.*?)</think>') then regexp_extract(solution, '(?s)<think>(.*?)</think>', 1) else solution end"
_FAMILIES = {"verification": fixed.COUNTED_VERIFICATION, "correction": fixed.COUNTED_CORRECTION, "exploration": fixed.COUNTED_EXPLORATION}
_THOUGHT = (
    f", tt as (select {_KEYS}, is_correct, {_THINK} as solution from t), tc as (select {_KEYS}, is_correct, solution, {C._COUNTS} from tt), th as materialized (select {_KEYS}, is_correct, length(solution) as length, len(list_filter(list_transform(regexp_split_to_array(solution, '\\n\\n+'), lambda x: {S.trim('x')}), lambda x: x <> '')) as phases, "
    + ", ".join(f"({' + '.join(v)}) as {k}" for k, v in _FAMILIES.items())
    + " from tc)"
)
_THOUGHTS = ("length", "phases", "verification", "correction", "exploration")


def _thoughts(spark, d):
    """A narrow row per trace: length, phases and counted patterns of its thinking."""
    t = T.traces(spark, d).withColumn("think", T.once(text.thinking(F.col("solution"))))
    low = F.lower("think")
    total = {k: sum((F.regexp_count(low, F.lit(fixed.COUNTED[x])) for x in names), F.lit(0)) for k, names in _FAMILIES.items()}
    return T.unique(t.select(*T.KEYS, "is_correct", F.length("think").alias("length"), F.size(text.segments(F.col("think"))).alias("phases"), *[c.alias(k) for k, c in total.items()]))


def _beside_first(x, columns):
    """Every later run's row beside run 0 of its rollout: a_ and b_ columns."""
    a = x.filter("trace_id = 0").select("rollout_id", *[F.col(c).alias(f"a_{c}") for c in columns])
    return a.join(x.filter("trace_id > 0").select("rollout_id", "problem_id", F.col("trace_id").alias("model"), *[F.col(c).alias(f"b_{c}") for c in columns]), "rollout_id")


_BOTH = ", bb as (select b.problem_id, b.trace_id as model, a.is_correct as ca, b.is_correct as cb, {0} from {1} a join {1} b on a.rollout_id = b.rollout_id and a.trace_id = 0 and b.trace_id > 0)"
_TH2 = _BOTH.format(", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in _THOUGHTS), "th")


@query(S.ROWS + _THOUGHT + _TH2 + " select model, case when ca then 'base_wins' else 'new_wins' end as outcome, count(*) as n, " + ", ".join(f"round(avg(a_{c}), 6) as base_{c}, round(avg(b_{c}), 6) as new_{c}" for c in _THOUGHTS) + " from bb where ca <> cb group by 1, 2")
def disagreement_groups(spark, d):
    """Where run 0 and a later run disagree: how long and in what way both thought, by who was right."""
    x = _beside_first(_thoughts(spark, d), ["is_correct", *_THOUGHTS]).filter("a_is_correct <> b_is_correct")
    return x.groupBy("model", F.when(F.col("a_is_correct"), "base_wins").otherwise("new_wins").alias("outcome")).agg(F.count("*").alias("n"), *[r6(F.avg(f"{s}_{c}")).alias(f"{w}_{c}") for c in _THOUGHTS for s, w in (("a", "base"), ("b", "new"))])


@query(S.EVAL + C._CASES + "select model, level, count(*) as n, count(*) filter (cb and not ca) as new_wins, count(*) filter (ca and not cb) as base_wins, count(*) filter (cb and not ca) - count(*) filter (ca and not cb) as net from (select b.model, b.level, a.is_correct as ca, b.is_correct as cb from ev a join ev b on a.id = b.id and a.model = 0 and b.model > 0) group by 1, 2")
def disagreement_levels(spark, d):
    """Wins each way and their balance, by level."""
    r = C._runs(spark, d)
    x = r.filter("model = 0").select("id", F.col("is_correct").alias("ca")).join(r.filter("model > 0").select("id", "model", "level", F.col("is_correct").alias("cb")), "id")
    new, base = F.count_if(F.col("cb") & ~F.col("ca")), F.count_if(F.col("ca") & ~F.col("cb"))
    return x.groupBy("model", "level").agg(F.count("*").alias("n"), new.alias("new_wins"), base.alias("base_wins"), (new - base).alias("net"))


@query(S.ROWS + _THOUGHT + _TH2 + " select model, count(*) as n, count(*) filter (a_verification > b_verification) as more_verification, count(*) filter (a_verification > b_verification and a_correction > b_correction) as more_of_both, count(*) filter (a_verification > b_verification and a_correction > b_correction and ca and not cb) as led_to_correction from bb group by 1")
def verification_led(spark, d):
    """How often run 0 verifies more than a later run, corrects more with it, and is right where the other is wrong."""
    x = _beside_first(_thoughts(spark, d), ["is_correct", *_THOUGHTS])
    more, both = F.col("a_verification") > F.col("b_verification"), F.col("a_correction") > F.col("b_correction")
    return x.groupBy("model").agg(F.count("*").alias("n"), F.count_if(more).alias("more_verification"), F.count_if(more & both).alias("more_of_both"), F.count_if(more & both & F.col("a_is_correct") & ~F.col("b_is_correct")).alias("led_to_correction"))


_PHASES = f", ph as (select problem_id, rollout_id, trace_id, count(*) as segs, count(*) filter (phase in ('verification', 'correction', 'exploration')) as seeking from (select *, {C._PRIORITY} as phase from s1) group by all), pl as (select problem_id, min(level) as level from problems group by 1)"


def _phases(spark, d):
    phase = F.transform(text.segments(F.col("solution")), text.priority_type)
    t = T.unique(T.traces(spark, d).select(*T.KEYS, "is_correct", phase.alias("phase")))
    return t.select(*T.KEYS, "is_correct", F.size("phase").alias("segs"), F.size(F.filter("phase", lambda x: x.isin("verification", "correction", "exploration"))).alias("seeking"))


def _with_level(spark, d, x):
    p = table(spark, d, "problems").groupBy("problem_id").agg(F.min("level").alias("level"))
    return x.join(p, "problem_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


@query(S.PLAIN + _PHASES + ", lv as (select coalesce(level, 0) as level, round(avg(seeking::double / segs) filter (is_correct), 6) as ratio_correct, round(avg(seeking::double / segs) filter (not is_correct), 6) as ratio_wrong, round(avg(seeking::double / segs) filter (is_correct) - avg(seeking::double / segs) filter (not is_correct), 6) as delta from t join ph using (problem_id, rollout_id, trace_id) left join pl using (problem_id) group by 1) select *, case when delta > 0.02 then 'more' when delta < -0.02 then 'less' else 'neutral' end as helps from lv where delta is not null")
def exploration_delta(spark, d):
    """By level: whether right answers seek more or less than wrong ones."""
    x = _with_level(spark, d, _phases(spark, d).filter("segs > 0")).withColumn("ratio", F.col("seeking") / F.col("segs"))
    on, off = F.avg(F.when(F.col("is_correct"), F.col("ratio"))), F.avg(F.when(~F.col("is_correct"), F.col("ratio")))
    g = x.groupBy("level").agg(r6(on).alias("ratio_correct"), r6(off).alias("ratio_wrong"), r6(on - off).alias("delta")).filter("delta is not null")
    return g.withColumn("helps", F.when(F.col("delta") > 0.02, "more").when(F.col("delta") < -0.02, "less").otherwise("neutral"))


@query(S.PLAIN + _PHASES + ", sg as (select t.problem_id, t.rollout_id, t.trace_id, is_correct, coalesce(seeking, 0) as seeking from t left join ph using (problem_id, rollout_id, trace_id))" + _BOTH.format("a.seeking as a_seeking, b.seeking as b_seeking", "sg") + " select model, coalesce(level, 0) as level, case when ca then 'base_wins' else 'new_wins' end as outcome, count(*) as n, round(avg(a_seeking - b_seeking), 6) as scaffold_diff from bb left join pl using (problem_id) where ca <> cb group by 1, 2, 3")
def scaffold_levels(spark, d):
    """Where two runs disagree: how many more scaffolding paragraphs run 0 has, by level and by who was right."""
    x = _beside_first(_phases(spark, d), ["is_correct", "seeking"]).filter("a_is_correct <> b_is_correct")
    return _with_level(spark, d, x).groupBy("model", "level", F.when(F.col("a_is_correct"), "base_wins").otherwise("new_wins").alias("outcome")).agg(F.count("*").alias("n"), r6(F.avg(F.col("a_seeking") - F.col("b_seeking"))).alias("scaffold_diff"))


_STRUCT = ("avg_dsr", "nonzero_dsr", "avg_steps")


@query(S.EVAL + ", st as (select model, avg(dsr) as avg_dsr, avg((dsr > 0)::int) as nonzero_dsr, avg(num_steps) as avg_steps from ev group by 1) select st.model, " + ", ".join(f"round(b.{c}, 6) as base_{c}, round(st.{c}, 6) as new_{c}, round(st.{c} - b.{c}, 6) as {c}_delta" for c in _STRUCT) + " from st, st b where b.model = 0 and st.model > 0")
def compare_structural(spark, d):
    """Dead-step ratios, their share above zero, and steps of every later run against run 0."""
    g = materialize(C._runs(spark, d).groupBy("model").agg(F.avg("dsr").alias("avg_dsr"), F.avg((F.col("dsr") > 0).cast("double")).alias("nonzero_dsr"), F.avg("num_steps").alias("avg_steps")))
    base = g.filter("model = 0").select(*[F.col(c).alias(f"b_{c}") for c in _STRUCT])
    return g.filter("model > 0").join(F.broadcast(base)).select("model", *[x for c in _STRUCT for x in (r6(f"b_{c}").alias(f"base_{c}"), r6(c).alias(f"new_{c}"), r6(F.col(c) - F.col(f"b_{c}")).alias(f"{c}_delta"))])


@query(S.ROWS + ", z as (select problem_id, count(*) as n, count(*) filter (is_correct) as c from t where trace_id = 0 group by 1), edge as (select count(*) as partial from z where c > 0 and c < n), h as (select trace_id as model, problem_id, count(*) as n, count(*) filter (is_correct) as c from t where trace_id > 0 and problem_id in (select problem_id from z where c = 0) group by 1, 2) select model, count(*) filter (c > 0) as solvable, count(*) as total, sum(c)::bigint as correct_traces, sum(n)::bigint as total_traces, count(*) filter (c > 0) + (select partial from edge) as edge_problems from h group by 1")
def hint_summary(spark, d):
    """Problems that run 0 never solves and each later condition: how many it solves, and how many problems then lie at the edge of what is solved."""
    t = materialize(C._outcomes(spark, d).select("problem_id", "trace_id", "is_correct"))
    z = t.filter("trace_id = 0").groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"))
    edge = z.agg(F.count_if((F.col("c") > 0) & (F.col("c") < F.col("n"))).alias("partial"))
    h = t.filter("trace_id > 0").join(z.filter("c = 0").select("problem_id"), "problem_id", "left_semi").groupBy(F.col("trace_id").alias("model"), "problem_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("c"))
    g = h.groupBy("model").agg(F.count_if(F.col("c") > 0).alias("solvable"), F.count("*").alias("total"), F.sum("c").alias("correct_traces"), F.sum("n").alias("total_traces"))
    return g.join(F.broadcast(edge)).select("model", "solvable", "total", "correct_traces", "total_traces", (F.col("solvable") + F.col("partial")).alias("edge_problems"))
