"""What p3 and p4 spend per text: no work on answers that cannot be copies, none twice, and equal results for all that."""

import random

import numpy as np
import pytest

from tracemill.llm import defects, truncation
from tracemill.llm.fillers import bare, units
from tracemill.llm.language import vote, votes_of

PROMPT = "Find the sum of the first ten odd numbers and give the result as one number."
PARTS = ["the", "and", "der die das", "le la les", "x2", "17", "Я не могу", "的", "ひらがな", "é", "\\boxed{4}", "$x$", "\\{", "\\text{of}", "```de ", "<think>", "</think>", "[more]", "...", ". A", "! ", "?\n\n", "\n", "​", " ", " ", PROMPT, PROMPT[:40], "word", "amber"]


def _odd(rng, n):
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_automaton_only_where_an_answer_may_be_a_copy(monkeypatch):
    made = []
    whole = defects.SuffixAutomaton
    monkeypatch.setattr(defects, "SuffixAutomaton", lambda w: made.append(w) or whole(w))
    defects._question.cache_clear()
    work = " ".join(f"we{chr(97 + i)} add" for i in range(26)) + " 100."
    assert defects.defect_of(PROMPT, work) is None and not made
    assert defects.defect_of(PROMPT, "The task was this: " + PROMPT) == "copy" and len(made) == 1
    defects._question.cache_clear()


def test_copy_is_as_the_automaton_says():
    rng = random.Random(4)
    seen = set()
    for t in _odd(rng, 1500):
        w = units(bare(t))
        covered = defects.SuffixAutomaton(units(PROMPT)).covered(w, defects.COPY_RUN)
        copy = covered >= defects.COPY_SHARE * len(w) and len(w) - covered <= defects.LEAD_IN and covered >= 0.5 * len(units(PROMPT))
        got = defects.defect_of(PROMPT, t)
        if got not in ("empty", "refusal"):
            assert (got == "copy") == copy, t
            seen.add(copy)
    assert seen == {True, False}


def test_votes_told_are_those_of_the_text():
    rng = random.Random(5)
    texts = _odd(rng, 1500)
    told = [v if d is None else None for d, v in (defects._judged(PROMPT, t) for t in texts)]
    assert sum(v is not None for v in told) > 100
    assert truncation.end_features(texts, None, told)[4] == truncation.end_features(texts)[4]
    for t, v in zip(texts, told):
        assert v is None or v == votes_of(units(bare(t)))
    assert {vote("the sum and the rest"), vote("der Wert ist die Summe"), vote("Я не знаю"), vote("")} == {"en", "de", "ru", ""}


def _sum(rows):
    out = {}
    for name, end, on in zip(*(x.tolist() for x in rows)):
        e, o = out.get(name, (0, 0))
        out[name] = (e + end, o + on)
    return out


@pytest.mark.parametrize("chars, pairs", [(100_000, 1 << 20), (900, 1 << 20), (900, 900), (900, 0)])
def test_counts_by_parts_are_those_of_the_whole(monkeypatch, chars, pairs):
    texts = _odd(random.Random(6), 300)
    code, _, _ = truncation._codes([truncation.INVISIBLE.sub("", t.rstrip()) for t in texts])
    real, ends = code > 3, truncation._is_end(code)
    want = {}
    for h in truncation._hashes(code):
        for name, end in zip((h[real] & ~np.uint64(1)).view(np.int64).tolist(), ends[real].tolist()):
            e, o = want.get(name, (0, 0))
            want[name] = (e + end, o + (not end))
    monkeypatch.setattr(truncation, "CACHED_CHARS", chars)
    monkeypatch.setattr(truncation, "MOST_PAIRS", pairs)
    got = _sum(truncation._counted(texts, np.full(1 << 6, ~np.uint64(0))))
    assert {k: v for k, v in got.items() if k not in truncation._SIGNS} == want


def test_contexts_of_two_codes_are_named_once(monkeypatch):
    named = []
    plain = truncation._hasher

    def hasher(code):
        names = plain(code)

        def counted(place, k):
            named.append((k, len(place)))
            return names(place, k)

        return counted

    monkeypatch.setattr(truncation, "_hasher", hasher)
    truncation._counted(["We add the numbers. Then we stop here."] * 200, np.zeros(1 << 6, np.uint64))
    assert 0 < sum(n for k, n in named if k == truncation.ORDERS[0]) < 100
