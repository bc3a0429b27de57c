"""Texts that hold nothing: blanks, empty tags and wrappers, and words that only fill an answer's place."""

from __future__ import annotations

import re

from tracemill.llm.common import INVISIBLE, WORD_OR_HAN

#: The same runs in a casefolded text without other scripts.
_ASCII_UNITS = re.compile("[a-z]+|[0-9]+")

_TAGS = re.compile(r"</?think>|\\(?:boxed|text|mathrm|mathbf)\b|```\w*", re.I)

# What stands in an answer's place without answering.
FILLERS = frozenset("n a|na|none|null|nil|nan|todo|tbd|tba|fixme|empty|no answer|no response|no solution|no output|not available|not applicable|placeholder|insert answer here|answer|answer here|final answer|the answer is|k a|keine angabe|keine antwort|sin respuesta|sans réponse|нет ответа|无|没有答案|暂无|待补充|空".split("|"))
#: More letters and digits in a line than a filler, and a part of a tag beside it, can have.
_MANY = re.compile(rf"(?:(?:[^\w\n]|_)*+[^\W_]){{{max(map(len, FILLERS)) + 17}}}")


def units(text: str) -> list[str]:
    """Runs of digits, single Chinese characters and runs of other letters, letter case ignored."""
    return _ASCII_UNITS.findall(text.lower()) if text.isascii() else WORD_OR_HAN.findall(text.casefold())


def bare(text: str) -> str:
    """The text without invisible characters, think tags, wrappers of formulas and code fences."""
    text = text if text.isascii() else INVISIBLE.sub("", text)
    return _TAGS.sub(" ", text) if "<" in text or "\\" in text or "```" in text else text


def _filler(text: str) -> bool:
    if _MANY.match(text):
        return False
    words = units(text)
    return not words or " ".join(words) in FILLERS or "".join(words) in FILLERS


def only_fillers(text: str) -> bool:
    """Whether a bare text is blank, a filler, or lines that each are blank or a filler."""
    return all(map(_filler, text.split("\n"))) or _filler(text.replace("\n", " "))


def holds_nothing(text: str | None) -> bool:
    """Whether a text, null ones too, is blank or holds tags, wrappers and fillers only."""
    if not text:
        return True
    # A first line with more letters than any filler is enough; the cut may leave part of a tag.
    return not _MANY.match(bare(text[:400])) and only_fillers(bare(text))
