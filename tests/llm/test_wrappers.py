"""Tags and cut marks are taken off texts of any length."""

import random

from tracemill.llm import defects, truncation


def test_only_tags_is_empty_at_any_length():
    for text in ("<think></think> " * 7, "\\boxed{} " * 20, "```python\n```\n" * 15, "<THINK></think>\n\\text{}\n" * 9):
        assert defects.defect_of("What is the sum of all these numbers?", text) == "empty"
    assert defects.defect_of("What is the sum?", "<think></think> " * 7 + "The sum is 12 and so we are done.") is None


def test_tags_do_not_count_in_a_copy():
    question = "What is the sum of all the even numbers that lie between one and fifty inclusive"
    assert defects.defect_of(question, "<think></think> " * 12 + question) == "copy"


def _whole(text):
    m = truncation._CUT_MARK.search(text.rstrip())
    return (text[: m.start()].rstrip(), True) if m else (text.rstrip(), False)


def test_long_cut_marks():
    base = "Then we add the numbers and"
    marks = ["." * 200, "…" * 90, "�" * 61, "<|end" + "x" * 100 + ">", "<|end" + "x" * 100 + "> [truncated]", "[" + " " * 90 + "truncated ]", "..." + " " * 100 + "...", "<end <" + "y" * 80 + ">" + "." * 80]
    for mark in marks:
        assert truncation.uncut(base + mark) == (base, True) == _whole(base + mark)
    rng = random.Random(2)
    pieces = ["a", " b", ".", "..", "...", "." * 70, " " * 65, "[", "]", "<", ">", "<|endoftext|>", "<eos>", "[cut]", "(more)", "{", "}", "|...", "�", "…", "snip"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert truncation.uncut(text) == _whole(text), text
