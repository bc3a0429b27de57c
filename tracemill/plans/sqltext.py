"""SQL text of the spine, for the queries' checks."""

from __future__ import annotations

from tracemill.functions import fixed


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


EDGE = q(r"^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$")


def trim(x: str) -> str:
    return f"regexp_replace({x}, {EDGE}, '', 'g')"


def hits(x: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({x}, {q(p)})::int" for p in patterns)


#: Lookarounds of the variable pattern by doubling its separators; those of the number pattern by blanking digits beside letters.
VARIABLE = r"(?:^|[\s=+\-*/^({,<>])([a-zA-Z])(?:[\s=+\-*/^)},.<>:\d_]|$)"
DOUBLED = r"([\s=+\-*/^,<>])"
NUMBER = r"\d{2,}(?:\.\d+)?|\d+\.\d+"

TRACES = f"""
r as (select * from (select *, row_number() over (partition by rollout_id order by loaded_at) as __k from rollouts) where __k = 1),
u as (select problem_id, rollout_id, coalesce(problem_text, '') as problem_text, coalesce(ground_truth, '') as ground_truth, shard, traces, unnest(range(len(traces)))::int as trace_id from r),
t as (select problem_id, rollout_id, trace_id, problem_text, ground_truth, shard,
        coalesce(traces[trace_id + 1].solution, '') as solution, coalesce(traces[trace_id + 1].answer, '') as answer, coalesce(traces[trace_id + 1].is_correct, false) as is_correct,
        coalesce(traces[trace_id + 1].num_tokens, len(list_filter(regexp_split_to_array(coalesce(traces[trace_id + 1].solution, ''), {q(r'[\s\p{Z}\x1c-\x1f\x{85}]+')}), lambda x: x <> '')))::bigint as num_tokens from u)"""

STEPS = (
    TRACES
    + f""",
g as (select problem_id, rollout_id, trace_id, list_filter(list_transform(regexp_split_to_array(solution, '\\n\\n+'), lambda x: {trim('x')}), lambda x: x <> '') as seg from t),
s0 as (select problem_id, rollout_id, trace_id, unnest(range(len(seg)))::int as step_id, seg from g),
s1 as (select problem_id, rollout_id, trace_id, step_id, seg[step_id + 1] as content, lower(seg[step_id + 1]) as low from s0),
s2 as (select *, 2.0::double * ({hits('low', fixed.VERIFICATION)}) as v, 1.5::double * ({hits('low', fixed.EXPLORATION)}) as e, 1.5::double * ({hits('low', fixed.CORRECTION)}) as c, 1.0::double * ({hits('content', fixed.COMPUTATION)}) as m from s1),
s as materialized (select problem_id, rollout_id, trace_id, step_id, content,
   case when contains(content, '\\boxed{{') or contains(content, '\\boxed ') then 'conclusion'
        when greatest(v, e, c, m) < 2 then 'derivation' when v = greatest(v, e, c, m) then 'verification' when e = greatest(v, e, c, m) then 'exploration' when c = greatest(v, e, c, m) then 'correction' else 'computation' end as step_type,
   length(content)::int as char_length,
   list_sort(list_distinct(list_concat(
     list_transform(regexp_extract_all(content, {q(fixed.SUBSCRIPTED)}), lambda x: regexp_replace(x, {q('^' + fixed.SUBSCRIPTED + '$')}, '\\1_\\2')),
     regexp_extract_all(content, {q(fixed.LATEX_EXPRESSION)}),
     regexp_extract_all(content, {q(fixed.LATEX_SYMBOL)}),
     list_filter(regexp_extract_all(regexp_replace(content, {q(DOUBLED)}, '\\1\\1', 'g'), {q(VARIABLE)}, 1), lambda x: x not in ('a', 'i', 'I', 'A')),
     regexp_extract_all(regexp_replace(regexp_replace(content, '([a-zA-Z])\\d', '\\1 ', 'g'), '\\d([a-zA-Z])', ' \\1', 'g'), {q(NUMBER)})))) as sym from s2)"""
)

GRAPH = (
    STEPS
    + """,
e1 as (select b.problem_id, b.rollout_id, b.trace_id, a.step_id as src, b.step_id as dst from s a join s b on a.rollout_id = b.rollout_id and a.trace_id = b.trace_id and a.step_id < b.step_id and a.step_id >= b.step_id - 10
   where (a.step_id = b.step_id - 1 and a.step_type in ('derivation', 'computation', 'conclusion') and b.step_type in ('derivation', 'computation', 'conclusion')) or list_has_any(a.sym, b.sym)),
e as materialized (select * from e1 union all
   select problem_id, rollout_id, trace_id, step_id - 1, step_id from s where step_type = 'conclusion' and step_id > 0 and not exists (select 1 from e1 where e1.rollout_id = s.rollout_id and e1.trace_id = s.trace_id and e1.dst = s.step_id)),
n as (select rollout_id, trace_id, max(step_id) as last_id, bool_or(step_type = 'conclusion') as concluded from s group by all),
live(rollout_id, trace_id, step_id) as (
   select s.rollout_id, s.trace_id, s.step_id from s join n using (rollout_id, trace_id) where s.step_type = 'conclusion' or (not concluded and step_id = last_id)
   union
   select e.rollout_id, e.trace_id, e.src from live l join e on e.rollout_id = l.rollout_id and e.trace_id = l.trace_id and e.dst = l.step_id),
ls as materialized (select s.*, l.step_id is not null as is_live from s left join live l on l.rollout_id = s.rollout_id and l.trace_id = s.trace_id and l.step_id = s.step_id),
agg as (select rollout_id, trace_id, count(*) as num_steps, count(*) filter (not is_live) as num_dead, count(*) filter (step_type = 'verification') as n_v, count(*) filter (step_type = 'verification' and is_live) as live_v from ls group by all),
ann as materialized (select t.problem_id, t.rollout_id, t.trace_id, t.is_correct, t.num_tokens, coalesce(num_steps, 0)::bigint as num_steps, coalesce(num_dead, 0)::bigint as num_dead,
   coalesce(num_dead::double / num_steps, 0.0) as dsr, coalesce(n_v::double / num_steps, 0.0) as verification_density,
   case when num_steps is null then 0.0 when n_v > 0 then live_v::double / n_v else 1.0 end as live_verification_rate,
   case when num_steps is null then 0 else length(solution) end::bigint as trace_length from t left join agg using (rollout_id, trace_id))"""
)

RECURSIVE = "with recursive " + GRAPH
PLAIN = "with " + STEPS
ROWS = "with " + TRACES

MOTIFS = (
    GRAPH
    + """,
d0 as (select *, step_id - row_number() over (partition by rollout_id, trace_id order by step_id) as isle from ls where not is_live),
th0 as (select *, step_id - row_number() over (partition by rollout_id, trace_id order by step_id) as isle from ls where not is_live and step_type = 'verification'
   and not exists (select 1 from e join live l on l.rollout_id = e.rollout_id and l.trace_id = e.trace_id and l.step_id = e.src where e.rollout_id = ls.rollout_id and e.trace_id = ls.trace_id and e.dst = ls.step_id)),
b0 as (select *, sum((is_live or step_type = 'exploration')::int) over (partition by rollout_id, trace_id order by step_id) as isle from ls),
motifs as materialized (
   select problem_id, rollout_id, trace_id, 'dead_cascade' as motif_type, 0 as type_rank, min(step_id) as first_id, count(*)::int as length, least(1.0, count(*)::double / 10) as severity from d0 group by problem_id, rollout_id, trace_id, isle having count(*) >= 3
   union all select problem_id, rollout_id, trace_id, 'verification_theater', 1, min(step_id), count(*)::int, 0.8::double from th0 group by problem_id, rollout_id, trace_id, isle
   union all select problem_id, rollout_id, trace_id, 'abandoned_branch', 2, min(step_id), count(*)::int, least(1.0, count(*)::double / 8) from b0 group by problem_id, rollout_id, trace_id, isle having count(*) >= 2 and bool_or(not is_live and step_type = 'exploration')
   union all select problem_id, rollout_id, trace_id, 'circular_revisit', 3, step_id, 1, 0.6::double from ls a where not is_live and step_type in ('derivation', 'computation') and len(sym) >= 2
     and exists (select 1 from ls b where b.rollout_id = a.rollout_id and b.trace_id = a.trace_id and b.is_live and b.step_id < a.step_id and len(list_intersect(a.sym, b.sym))::double / len(a.sym) >= 0.6)),
mo as materialized (select *, row_number() over (partition by rollout_id, trace_id order by first_id, type_rank, length, severity) - 1 as motif_seq from motifs)"""
)

QUALITY = (
    GRAPH
    + """,
qd as materialized (select a.problem_id, a.rollout_id, a.trace_id, a.step_id, a.step_type,
   case when step_type = 'verification' then
          case when exists (select 1 from e where e.rollout_id = a.rollout_id and e.trace_id = a.trace_id and e.dst = a.step_id) then
                 case when exists (select 1 from e join live l on l.rollout_id = e.rollout_id and l.trace_id = e.trace_id and l.step_id = e.src where e.rollout_id = a.rollout_id and e.trace_id = a.trace_id and e.dst = a.step_id) then 'redundant_verification' else 'verification_theater' end
               when step_id > 0 and not exists (select 1 from live l where l.rollout_id = a.rollout_id and l.trace_id = a.trace_id and l.step_id = a.step_id - 1) then 'verification_theater' else 'redundant_verification' end
        when step_type in ('computation', 'derivation') and len(sym) > 0 and exists (select 1 from ls b where b.rollout_id = a.rollout_id and b.trace_id = a.trace_id and b.is_live and len(b.sym) > 0
             and len(list_intersect(a.sym, b.sym))::double / (len(a.sym) + len(b.sym) - len(list_intersect(a.sym, b.sym))) >= 0.6) then 'circular_revisit'
        when step_type in ('exploration', 'derivation', 'computation') and len(sym) > 0 and exists (select 1 from ls b where b.rollout_id = a.rollout_id and b.trace_id = a.trace_id and b.is_live and b.step_id > a.step_id and len(list_intersect(a.sym, b.sym)) >= 2) then 'productive_dead_end'
        when step_type = 'exploration' then 'wasteful_exploration' when step_type = 'correction' then 'failed_correction' when step_type = 'computation' then 'abandoned_computation' else 'generic_dead' end as quality
   from ls a where not is_live),
qc as (select t.problem_id, t.rollout_id, t.trace_id, """
    + ", ".join(f"count(*) filter (quality = '{k}') as {k}" for k in fixed.PENALTY)
    + """ from t left join qd using (rollout_id, trace_id) group by all),
qr as materialized (select a.*, """
    + ", ".join(fixed.PENALTY)
    + ", case when num_steps = 0 then 1.0 else round(greatest(0.0, least(1.0, 1.0 - (0.0::double + "
    + " + ".join(f"{k} * {v}::double" for k, v in fixed.PENALTY.items())
    + """) / num_steps)), 9) end as quality_reward, case when instr(solution, '\\boxed{') > 0 then length(solution) * (1.0::double - (instr(solution, '\\boxed{') - 1)::double / length(solution)) else 0.0 end as post_answer_len, answer, ground_truth, solution, shard
   from ann a join qc using (problem_id, rollout_id, trace_id) join t using (problem_id, rollout_id, trace_id))"""
)


def capped(chosen: str, rejected: str, kind: str, source: str = "ann", k: int = 3) -> str:
    return f"""select problem_id, chosen_rollout_id, chosen_trace_id, chosen_dsr, chosen_correct, rejected_rollout_id, rejected_trace_id, rejected_dsr, rejected_correct, '{kind}' as pair_type from (
   select c.problem_id, c.rollout_id as chosen_rollout_id, c.trace_id as chosen_trace_id, c.dsr as chosen_dsr, c.is_correct as chosen_correct, r.rollout_id as rejected_rollout_id, r.trace_id as rejected_trace_id, r.dsr as rejected_dsr, r.is_correct as rejected_correct,
     row_number() over (partition by c.problem_id order by c.rollout_id, c.trace_id, r.rollout_id, r.trace_id) as k
   from {source} c join {source} r on c.problem_id = r.problem_id where ({chosen}) and ({rejected})) where k <= {k}"""


EFFICIENCY = capped("c.is_correct and c.dsr < 0.15::double", "r.is_correct and r.dsr > 0.35::double", "efficiency")
PRODUCTIVE = capped("c.is_correct and c.verification_density > 0 and c.live_verification_rate >= 0.8::double", "r.is_correct and r.verification_density > 0 and r.live_verification_rate <= 0.3::double", "productive_exploration")
DIRECTION = capped("c.is_correct and c.dsr < 0.3::double", "not r.is_correct and r.dsr > 0.3::double", "direction")

FLAGS = (
    MOTIFS
    + """,
fl as materialized (select a.problem_id, a.rollout_id, a.trace_id, a.is_correct, a.dsr, coalesce(max(severity), 0.0) as worst, """
    + ", ".join(f"coalesce(bool_or(motif_type = '{k}'), false) as has_{k}" for k in ("dead_cascade", "verification_theater", "abandoned_branch"))
    + """ from ann a left join motifs m using (rollout_id, trace_id) where a.is_correct group by all)"""
)

EXCISION = """select problem_id, rollout_id, trace_id, motif_type, first_id, chosen_solution, 0.0::double as chosen_dsr, dsr as rejected_dsr from (
   select *, row_number() over (partition by rollout_id, trace_id order by severity desc, motif_seq) as k from (
     select m.problem_id, m.rollout_id, m.trace_id, m.motif_type, m.first_id, m.severity, m.motif_seq, a.dsr, t.solution,
       (select string_agg(content, E'\\n\\n' order by step_id) from s where s.rollout_id = m.rollout_id and s.trace_id = m.trace_id and (s.step_id < m.first_id or s.step_id >= m.first_id + m.length)) as chosen_solution
     from mo m join ann a using (rollout_id, trace_id) join t using (rollout_id, trace_id) where a.is_correct and m.severity >= 0.5 and m.length >= 3)
   where length(chosen_solution) < length(solution) * 0.95::double and length(chosen_solution) >= 50) where k <= 2"""

REPLACEMENT = """select c.problem_id, c.rollout_id as chosen_rollout_id, c.trace_id as chosen_trace_id, c.dsr as chosen_dsr, true as chosen_correct, r.rollout_id as rejected_rollout_id, r.trace_id as rejected_trace_id, r.dsr as rejected_dsr, true as rejected_correct, 'contrastive_replacement' as pair_type from
   (select * from (select *, row_number() over (partition by problem_id order by dsr, rollout_id, trace_id) as k from fl where worst < 0.3::double) where k = 1) c join
   (select * from (select *, row_number() over (partition by problem_id order by rollout_id, trace_id) as k from fl where worst >= 0.5) where k <= 3) r using (problem_id)"""


def contrast(kind: str) -> str:
    return f"""select problem_id, chosen_rollout_id, chosen_trace_id, chosen_dsr, true as chosen_correct, rejected_rollout_id, rejected_trace_id, rejected_dsr, true as rejected_correct, 'contrastive_{kind}' as pair_type from (
   select c.problem_id, c.rollout_id as chosen_rollout_id, c.trace_id as chosen_trace_id, c.dsr as chosen_dsr, r.rollout_id as rejected_rollout_id, r.trace_id as rejected_trace_id, r.dsr as rejected_dsr,
     row_number() over (partition by c.problem_id order by r.dsr desc, r.rollout_id, r.trace_id, c.dsr, c.rollout_id, c.trace_id) as k
   from fl c join fl r using (problem_id) where not c.has_{kind} and r.has_{kind} and r.dsr - c.dsr >= 0.05::double) where k <= 3"""


CONTRAST = " union all ".join(contrast(k) for k in ("dead_cascade", "verification_theater", "abandoned_branch"))
ALL_PAIRS = (
    "select * from ("
    + " union all by name ".join(
        [EFFICIENCY, PRODUCTIVE, DIRECTION, REPLACEMENT, *[contrast(k) for k in ("dead_cascade", "verification_theater", "abandoned_branch")], f"select problem_id, rollout_id as chosen_rollout_id, trace_id as chosen_trace_id, chosen_dsr, true as chosen_correct, rollout_id as rejected_rollout_id, trace_id as rejected_trace_id, rejected_dsr, true as rejected_correct, 'contrastive_excision' as pair_type from ({EXCISION})"]
    )
    + ")"
)

WORDS = q(r"[\s\p{Z}\x1c-\x1f\x{85}]+")
RIR = (
    GRAPH
    + f""",
rs as materialized (select *, case step_type when 'exploration' then 'assumption' when 'correction' then 'derivation' else step_type end as rtype, len(list_filter(regexp_split_to_array(content, {WORDS}), lambda x: x <> '')) as tokens from ls),
rf as materialized (select problem_id, rollout_id, trace_id, count(*) as total, count(*) filter (not is_live) as dead, count(*) filter (rtype = 'conclusion') as concluded, count(*) filter (rtype = 'verification') as verif, count(*) filter (rtype = 'verification' and not is_live) as dead_verif,
   sum(tokens)::bigint as tokens, coalesce(sum(tokens) filter (not is_live), 0)::bigint as dead_tokens, coalesce(sum(tokens) filter (rtype = 'verification' and not is_live), 0)::bigint as dead_verif_tokens from rs group by all),
fe as materialized (select f.*, t.is_correct, dead::double / total as dsr, case when verif > 0 then dead_verif::double / verif else 0.0 end as vii, case when tokens > 0 then dead_tokens::double / tokens else 0.0 end as dead_token_ratio from rf f join t using (problem_id, rollout_id, trace_id))"""
)

PREFIX = (
    STEPS
    + """,
e1 as (select b.rollout_id, b.trace_id, a.step_id as src, b.step_id as dst from s a join s b on a.rollout_id = b.rollout_id and a.trace_id = b.trace_id and a.step_id < b.step_id and a.step_id >= b.step_id - 10
   where (a.step_id = b.step_id - 1 and a.step_type in ('derivation', 'computation', 'conclusion') and b.step_type in ('derivation', 'computation', 'conclusion')) or list_has_any(a.sym, b.sym)),
e as materialized (select * from e1 union all
   select rollout_id, trace_id, step_id - 1, step_id from s where step_type = 'conclusion' and step_id > 0 and not exists (select 1 from e1 where e1.rollout_id = s.rollout_id and e1.trace_id = s.trace_id and e1.dst = s.step_id)),
pre as (select problem_id, rollout_id, trace_id, step_id as i, bool_or(step_type = 'conclusion') over (partition by rollout_id, trace_id order by step_id) as concluded from s),
pl(rollout_id, trace_id, i, step_id) as (
   select p.rollout_id, p.trace_id, p.i, s.step_id from pre p join s on s.rollout_id = p.rollout_id and s.trace_id = p.trace_id and s.step_id <= p.i where s.step_type = 'conclusion' or (not concluded and s.step_id = p.i)
   union select l.rollout_id, l.trace_id, l.i, e.src from pl l join e on e.rollout_id = l.rollout_id and e.trace_id = l.trace_id and e.dst = l.step_id),
x as materialized (select p.problem_id, p.rollout_id, p.trace_id, p.i, s.step_id, s.step_type, s.sym, l.step_id is not null as is_live from pre p join s on s.rollout_id = p.rollout_id and s.trace_id = p.trace_id and s.step_id <= p.i
   left join pl l on l.rollout_id = p.rollout_id and l.trace_id = p.trace_id and l.i = p.i and l.step_id = s.step_id),
xd as (select *, step_id - row_number() over (partition by rollout_id, trace_id, i order by step_id) as isle from x where not is_live),
xt as (select *, step_id - row_number() over (partition by rollout_id, trace_id, i order by step_id) as isle from x where not is_live and step_type = 'verification'
   and not exists (select 1 from e join pl l on l.rollout_id = e.rollout_id and l.trace_id = e.trace_id and l.step_id = e.src where l.i = x.i and e.rollout_id = x.rollout_id and e.trace_id = x.trace_id and e.dst = x.step_id)),
xb as (select *, sum((is_live or step_type = 'exploration')::int) over (partition by rollout_id, trace_id, i order by step_id) as isle from x),
xm as materialized (
   select rollout_id, trace_id, i, 'dead_cascade' as m, min(step_id) as a, max(step_id) as b from xd group by rollout_id, trace_id, i, isle having count(*) >= 3
   union all select rollout_id, trace_id, i, 'verification_theater', min(step_id), max(step_id) from xt group by rollout_id, trace_id, i, isle
   union all select rollout_id, trace_id, i, 'abandoned_branch', min(step_id), max(step_id) from xb group by rollout_id, trace_id, i, isle having count(*) >= 2 and bool_or(not is_live and step_type = 'exploration')
   union all select rollout_id, trace_id, i, 'circular_revisit', step_id, step_id from x u where not is_live and step_type in ('derivation', 'computation') and len(sym) >= 2
     and exists (select 1 from x v where v.rollout_id = u.rollout_id and v.trace_id = u.trace_id and v.i = u.i and v.is_live and v.step_id < u.step_id and len(list_intersect(u.sym, v.sym))::double / len(u.sym) >= 0.6)),
tl as (select p.problem_id, p.rollout_id, p.trace_id, p.i as step_id, p.i + 1 as num_steps, (select count(*) from xm where xm.rollout_id = p.rollout_id and xm.trace_id = p.trace_id and xm.i = p.i)::int as num_motifs,
   (select count(*) from xd where xd.rollout_id = p.rollout_id and xd.trace_id = p.trace_id and xd.i = p.i)::int as num_dead,
   case when exists (select 1 from xm where xm.rollout_id = p.rollout_id and xm.trace_id = p.trace_id and xm.i = p.i and m = 'dead_cascade' and b >= p.i - 1) then 'redirect_cascade'
        when exists (select 1 from xm where xm.rollout_id = p.rollout_id and xm.trace_id = p.trace_id and xm.i = p.i and m = 'verification_theater' and b >= p.i) then 'skip_theater'
        when exists (select 1 from xm where xm.rollout_id = p.rollout_id and xm.trace_id = p.trace_id and xm.i = p.i and m = 'abandoned_branch' and b >= p.i and b - a + 1 >= 3) then 'redirect_branch' end as intervention from pre p)"""
)

#: Evaluation rows: the first trace of each rollout as the baseline, the second as the experiment.
EVAL = (
    "with recursive "
    + GRAPH
    + """,
pb as (select problem_id, min(level) as level, min(category) as category from problems group by 1),
ev as materialized (select a.rollout_id as id, a.trace_id as model, t.shard as benchmark, coalesce(category, '') as subject, coalesce(level, 0) as level, a.is_correct, a.num_tokens, a.dsr, a.num_steps, a.num_dead
   from ann a join t using (problem_id, rollout_id, trace_id) left join pb using (problem_id)) """
)
PAIRS = "with pr as (select * from (select *, row_number() over (partition by pair_id order by built_at) as __k from preference_pairs) where __k = 1) "
