"""Column functions over trace text: segments, step types, symbols, answers, counts.

All are Catalyst expressions, so scans stay columnar and no text leaves the JVM. Literal
patterns are tested with ``contains``; a real pattern is guarded by a literal it includes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import fixed

#: Blanks at an end, as Unicode has them.
EDGE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def trim_all(c: Column) -> Column:
    """The text without blanks of any script at its ends."""
    return F.regexp_replace(c, EDGE, "")


def segments(text: Column, delimiter: str = r"\n\n+") -> Column:
    """Trimmed, non-empty paragraphs in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), delimiter)
    return F.filter(F.transform(parts, trim_all), lambda x: x != "")


def _literal_part(pattern: str) -> str:
    """The longest piece of a pattern that every match contains."""
    plain = re.sub(r"\([^()]*\)\??|\[[^\]]*\]\??|.\?|\\[bds]|\.\*\??|\\\\?[wW]", "\0", pattern)
    plain = plain.replace("\\\\", "\1").replace("\\{", "{").replace("\\}", "}").replace("\\d+", "\0").replace("\\", "\0").replace("\1", "\\")
    plain = re.sub(r"[*+^$|]", "\0", plain)
    return max(plain.split("\0"), key=len)


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern matches somewhere."""
    if re.fullmatch(r"[\w ',\-]+", pattern):
        return F.contains(text, F.lit(pattern))
    part = _literal_part(pattern)
    hit = F.regexp_like(text, F.lit(pattern))
    return F.contains(text, F.lit(part)) & hit if len(part) > 1 else hit


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns match at least once."""
    return reduce(lambda a, b: a + b, [has(text, p).cast("int") for p in patterns])


def step_type(text: Column, lowered: Column) -> Column:
    """The type of a paragraph: boxed answers conclude; else the family with most weight, ties in family order, derivation below 2."""
    v = hits(lowered, fixed.VERIFICATION) * F.lit(2.0)
    e = hits(lowered, fixed.EXPLORATION) * F.lit(1.5)
    c = hits(lowered, fixed.CORRECTION) * F.lit(1.5)
    m = hits(text, fixed.COMPUTATION) * F.lit(1.0)
    score = F.array(v, e, c, m)
    best = lambda s: F.when(F.array_max(s) < 2.0, "derivation").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("verification", "exploration", "correction", "computation")]), F.array_position(s, F.array_max(s)).cast("int")))
    # A one-element transform evaluates the scores once.
    chosen = F.element_at(F.transform(F.array(score), best), 1)
    return F.when(F.contains(text, F.lit("\\boxed{")) | F.contains(text, F.lit("\\boxed ")), "conclusion").otherwise(chosen)


def symbols(text: Column) -> Column:
    """Sorted distinct mathematical symbols: subscripted letters, LaTeX expressions and names, letters in formulas, numbers."""
    every = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    subscripted = F.zip_with(every(fixed.SUBSCRIPTED, 1), every(fixed.SUBSCRIPTED, 2), lambda a, b: F.concat(a, F.lit("_"), b))
    named = F.transform(every(fixed.LATEX_SYMBOL), lambda x: F.concat(F.lit("\\"), x))
    letters = F.array_except(every(fixed.VARIABLE), F.array(*[F.lit(x) for x in fixed.NOT_VARIABLES]))
    return F.array_sort(F.array_distinct(F.concat(subscripted, every(fixed.LATEX_EXPRESSION, 0), named, letters, every(fixed.NUMBER))))


def boxed_answer(text: Column) -> Column:
    r"""The content of the last closed ``\boxed{...}`` with balanced braces, trimmed; '' without one.

    Reading stops at a box that never closes; boxes inside a closed box are part of it.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)(\\boxed\{|\{|\}|[^{}\\]+|\\)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        opens = t == "\\boxed{"
        deeper = opens | (t == "{")
        return (
            F.when(s["depth"] == 0, F.when(opens, F.struct(F.lit(1).alias("depth"), F.lit("").alias("open"), s["last"].alias("last"))).otherwise(s))
            .when((t == "}") & (s["depth"] == 1), F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), s["open"].alias("last")))
            .otherwise(F.struct((s["depth"] + F.when(deeper, 1).when(t == "}", -1).otherwise(0)).alias("depth"), F.concat(s["open"], t).alias("open"), s["last"].alias("last")))
        )

    return trim_all(F.aggregate(tokens, start, step, lambda s: s["last"]))


def normalize_answer(answer: Column) -> Column:
    """An answer for comparison: wrappers, units, signs of currency and base, separators and blanks removed, fractions and roots braced. The order of the steps is part of the result."""
    a = trim_all(answer)
    for wrapper in ("text", "mathrm", "mathbf", "mbox"):
        a = F.regexp_replace(a, r"(?s)^\\" + wrapper + r"\{(.*)\}\z", "$1")
    drop = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    a = drop(a, "^\\circ")
    a = F.regexp_replace(a, r"\\(?:text|mbox|mathrm)\{[^}]*\}", "")
    a = drop(drop(a, "\\$"), "$")
    a = F.regexp_replace(a, r"_\{?\d+\}?$", "")
    a = F.regexp_replace(a, r"^[a-zA-Z]\s*[=∈]\s*", "")
    a = drop(a, "\\in")
    a = F.replace(a, F.lit("\\dfrac"), F.lit("\\frac"))
    a = F.regexp_replace(a, r"\\frac\s*([0-9a-zA-Z])\s*([0-9a-zA-Z])", r"\\frac{$1}{$2}")
    a = F.regexp_replace(a, r"\\sqrt\s*([0-9]+)", r"\\sqrt{$1}")
    a = drop(drop(a, "\\left"), "\\right")
    a = F.regexp_replace(a, r"^\.", "0.")
    a = drop(drop(a, ",\\!"), ",")
    return F.regexp_replace(F.regexp_replace(a, r"\s+", ""), r"\.+$", "")


def correct(predicted: Column, truth: Column, lenient: bool = False) -> Column:
    """Whether two answers are equal once normalised; never for empty ones or nulls. ``lenient`` also drops one pair of outer brackets."""
    p, t = normalize_answer(predicted), normalize_answer(truth)
    same = (p != "") & (p == t)
    if lenient:
        bare = lambda c: F.regexp_replace(c, r"^[(\[{](.*)[)\]}]$", "$1")
        same = same | ((bare(p) != "") & (bare(p) == bare(t)))
    return F.coalesce(same, F.lit(False))


def _bare_number(answer: Column) -> Column:
    a = F.regexp_replace(F.regexp_replace(trim_all(F.coalesce(answer, F.lit(""))), r"[$,]", ""), r"\.+$", "")
    a = F.regexp_replace(a, r"\\(?:text|mathrm|mathbf|mathit|textbf)\{([^}]*)\}", "$1")
    return F.regexp_replace(a, r"\s+", "")


def numeric_equal(predicted: Column, truth: Column) -> Column:
    """Whether two answers are the same number, or the same text where one is no number; two empty answers are equal."""
    p, t = _bare_number(predicted), _bare_number(truth)
    x, y = p.try_cast("double"), t.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(p) == F.lower(t))


def light_answer(answer: Column) -> Column:
    a = trim_all(F.coalesce(answer, F.lit("")))
    a = F.regexp_replace(a, r"\\(?:text|mathrm|mathbf|mbox)\{([^}]*)\}", "$1")
    a = F.replace(F.replace(F.replace(a, F.lit("\\dfrac"), F.lit("\\frac")), F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(a, r"\s+", ""), r"\.+$", "")


def reasoning_body(text: Column) -> Column:
    """What follows the first </think>, trimmed; the whole text without one."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, trim_all(F.substring(text, at + 8, F.length(text)))).otherwise(text)


def thinking(text: Column) -> Column:
    """What stands inside the first <think>...</think>; the whole text without one."""
    p = r"(?s)<think>(.*?)</think>"
    return F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, 1)).otherwise(text)


def word_count(text: Column) -> Column:
    """Blank-separated words; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x1c-\x1f\x85]+"), lambda x: x != ""))


def answer_position(text: Column) -> Column:
    """Where the first boxed answer starts, as a share of the text; 1 without one."""
    at = F.instr(text, "\\boxed{")
    return F.when(at > 0, (at - 1) / F.length(text)).otherwise(F.lit(1.0))


def keyword_clean(text: Column) -> Column:
    """The text without spans that start with a line of verification and reach to a blank line or a new topic."""
    one_of = lambda c, words, f: reduce(lambda a, b: a | b, [f(c, F.lit(w)) for w in words])
    state = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        bare = trim_all(line)
        opens = one_of(F.lower(bare), fixed.VERIFY_KEYWORDS, F.contains)
        ends = (bare == "") | one_of(bare, fixed.NEW_TOPIC, F.startswith)
        keep = F.struct(F.lit(False).alias("skip"), F.array_append(s["out"], line).alias("out"))
        skip = F.struct(F.lit(True).alias("skip"), s["out"].alias("out"))
        return F.when(opens, skip).when(s["skip"] & ~ends, skip).otherwise(keep)

    lines = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), state, step, lambda s: s["out"])
    return trim_all(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def pattern_counts(text: Column) -> Column:
    """Counts of non-overlapping matches by pattern name, letter case ignored."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.create_map(*[x for k, p in fixed.COUNTED.items() for x in (F.lit(k), F.regexp_count(lowered, F.lit(p)))])


def priority_type(text: Column) -> Column:
    """The first kind that holds of verification, correction, exploration, conclusion; else derivation."""
    low = F.lower(text)
    any_of = lambda names: reduce(lambda a, b: a | b, [has(low, fixed.COUNTED[k]) for k in names])
    return F.when(any_of(fixed.COUNTED_VERIFICATION), "verification").when(any_of(fixed.COUNTED_CORRECTION), "correction").when(any_of(fixed.COUNTED_EXPLORATION), "exploration").when(F.contains(text, F.lit("\\boxed{")), "conclusion").otherwise("derivation")


def answer_hint(truth: Column) -> Column:
    """A hint of an answer's kind and size that does not give it away."""
    digits = F.regexp_like(truth, F.lit(r"^\d+$"))
    kind = F.when(digits, "The answer is a positive integer.").when(F.contains(truth, F.lit("/")) | F.contains(truth, F.lit("frac")), "The answer is a fraction.").when(F.contains(truth, F.lit(".")), "The answer is a decimal number.")
    v = F.replace(truth, F.lit(","), F.lit("")).try_cast("double")
    size = F.when(v < 0, "The answer is negative.").when(v < 10, "The answer is a small number (single digit).").when(v < 100, "The answer is a two-digit number.").when(v < 1000, "The answer is a three-digit number.")
    both = F.concat_ws(" ", kind, size)
    return F.when(both == "", "Think carefully about this problem step by step.").otherwise(both)


def key_step_hint(solution: Column) -> Column:
    """The paragraph or sentence of a solution with most signals of a key step, as a hint."""
    clean = F.regexp_replace(F.coalesce(solution, F.lit("")), r"(?s)\[asy\].*?\[/asy\]", "")
    sentences = F.split(clean, r"(?<=[.!?])\s+(?=[A-Z])")
    parts = F.filter(F.flatten(F.transform(sentences, lambda s: F.transform(F.split(s, "\n\n"), trim_all))), lambda x: x != "")
    one_of = lambda c, words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])

    def scored(x: Column, i: Column) -> Column:
        low = F.lower(x)
        s = F.when(one_of(x, fixed.HINT_MATH), 2).otherwise(0) + F.when(one_of(low, fixed.HINT_TECHNIQUE), 3).otherwise(0) - F.when(one_of(low, fixed.HINT_RESTATEMENT), 5).otherwise(0)
        s = s - F.when(F.length(x) > 500, 1).otherwise(0) - F.when(F.length(x) < 40, 1).otherwise(0)
        return F.struct((-s).alias("score"), i.alias("place"), x.alias("part"))

    ranked = F.array_sort(F.filter(F.transform(parts, scored), lambda s: (F.length(s["part"]) >= 20) & ~F.contains(s["part"], F.lit("\\boxed{"))))
    best = F.try_element_at(ranked, F.lit(1))
    fallback = F.try_element_at(F.filter(parts, lambda x: (F.length(x) > 40) & ~F.contains(x, F.lit("\\boxed{"))), F.lit(1))
    return (
        F.when(best["score"] < 0, F.concat(F.lit("Key approach: "), F.substring(best["part"], 1, 250), F.when(F.length(best["part"]) > 250, "...").otherwise("")))
        .when(fallback.isNotNull(), F.concat(F.lit("Consider: "), F.substring(fallback, 1, 200)))
        .otherwise(fixed.HINT_DEFAULT)
    )


def last_boxed(text: Column) -> Column:
    r"""The content of the last ``\boxed{`` alone, trimmed; null where there is none or it never closes."""
    tail = F.when(F.contains(text, F.lit("\\boxed{")), F.substring_index(text, "\\boxed{", -1))
    tokens = F.regexp_extract_all(tail, F.lit(r"(?s)(\{|\}|[^{}]+)"), F.lit(1))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(s["inner"], t)).otherwise(s["inner"]).alias("inner")))

    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("inner"))
    return F.aggregate(tokens, start, step, lambda s: F.when(s["depth"] == 0, trim_all(s["inner"])))


def lenient_correct(predicted: Column, truth: Column) -> Column:
    r"""As ``correct``, or equal once one side loses its outer brackets, or one of the two values (or both) of a truth with a single ``\pm``."""
    p, t = normalize_answer(predicted), normalize_answer(truth)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    wrapped = lambda c: (F.length(c) >= 2) & reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) & F.endswith(c, F.lit(y)) for x, y in ("()", "{}", "[]")])
    sides = F.split(t, r"\\pm")
    signed = lambda sign: normalize_answer(F.concat(F.element_at(sides, 1), F.lit(sign), F.try_element_at(sides, F.lit(2))))
    plus, minus = signed("+"), signed("-")
    either = (F.size(sides) == 2) & ((p == plus) | (p == minus) | (F.contains(p, plus) & F.contains(p, minus)))
    return F.coalesce((p != "") & ((p == t) | (wrapped(p) & (inner(p) == t)) | (wrapped(t) & (inner(t) == p)) | either), F.lit(False))


def light_correct(predicted: Column, truth: Column) -> Column:
    """Whether two answers are equal after the light clean-up and not empty."""
    p = light_answer(predicted)
    return (p != "") & (p == light_answer(truth))


def record_answer(original_answer: Column) -> Column:
    """What a record answers: its last box, else its last line."""
    return F.coalesce(last_boxed(original_answer), F.element_at(F.split(trim_all(F.coalesce(original_answer, F.lit(""))), "\n"), -1))


def letter_answer(text: Column) -> Column:
    """The boxed answer of a multiple-choice reply, else the first letter A to D that stands alone in its last 200 characters."""
    boxed = boxed_answer(text)
    return F.when(boxed != "", boxed).otherwise(F.regexp_extract(F.right(F.coalesce(text, F.lit("")), F.lit(200)), r"\b([ABCD])\b", 1))


def raw_segments(text: Column) -> Column:
    """Paragraphs as they stand, with their places among all pieces, blank ones counted but left out: array<struct<id, step_type, content, length>>."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n\n+")
    rows = F.transform(parts, lambda x, i: F.struct(i.alias("id"), step_type(x, F.lower(x)).alias("step_type"), x.alias("content"), F.length(x).alias("length")))
    return F.filter(rows, lambda s: trim_all(s["content"]) != "")


def segment_phases(text: Column) -> Column:
    """Paragraphs by the first kind that holds, with their full length and first 100 characters."""
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda x: F.struct(x.alias("x"), trim_all(x).alias("p")))
    return F.transform(F.filter(rows, lambda s: s["p"] != ""), lambda s, i: F.struct(i.alias("segment"), priority_type(s["p"]).alias("phase"), F.length(s["x"]).alias("length"), F.substring(s["p"], 1, 100).alias("preview")))


def excerpt(text: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, marked where there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def delta_label(base: Column, new: Column, percent: bool = True) -> Column:
    """A signed difference: in percent with one place, or with two places."""
    d = new - base
    shown = F.format_string("%.1f%%", d * 100) if percent else F.format_string("%.2f", d)
    return F.when(d >= 0, F.concat(F.lit("+"), shown)).otherwise(shown)


def sft_record(question: Column, solution: Column) -> Column:
    """A training record of one turn with the fixed system prompt."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.struct(F.array(turn("human", question), turn("gpt", solution)).alias("conversations"), F.lit(fixed.SYSTEM_PROMPT).alias("system"))
