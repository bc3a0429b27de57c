"""Repetition inside one text: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import WORD_OR_HAN, hashed_words, inside, map_texts, mix64, ngram_hashes, prefix_hashes

_NUMBER = re.compile(r"\d+")
LENGTHS = (3, 5, 8, 13)


def _covered(words: np.ndarray, prefix: tuple[np.ndarray, np.ndarray], counts: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each word: whether it lies in a run of n words that occurred earlier in its text."""
    hit = np.zeros(len(words) + 1, np.int32)
    ok = np.flatnonzero(inside(counts, n))
    if len(ok):
        key = ngram_hashes(words, n, prefix)[ok] ^ mix64(doc[ok] + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(ok), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        at = ok[again]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
    return np.cumsum(hit[:-1]) > 0


def _line_shares(text: str) -> tuple[float, int]:
    seen: set[str] = set()
    total = twice = lines = 0
    for line in text.split("\n"):
        line = line.strip()
        if line:
            lines += 1
            total += len(line)
            if line in seen:
                twice += len(line)
            seen.add(line)
    return (twice / total if total else 0.0), lines


def measure(texts: list[str | None], lengths: tuple[int, ...] = LENGTHS) -> list:
    """n_words, then for each length the share of words and of characters covered, then the share of characters in repeated lines."""
    lists = [WORD_OR_HAN.findall(_NUMBER.sub("0", t.casefold())) if t else [] for t in texts]
    words, counts = hashed_words(lists)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    size = np.fromiter((len(w) for x in lists for w in x), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(counts)])

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[starts])

    chars = per_text(size)
    out: list = [counts]
    prefix = prefix_hashes(words)
    for n in lengths:
        cover = _covered(words, prefix, counts, doc, n)
        out.append(per_text(cover) / np.maximum(counts, 1))
        out.append(per_text(cover * size) / np.maximum(chars, 1))
    shares = [_line_shares(t) if t else (0.0, 0) for t in texts]
    return [*out, [s for s, _ in shares]]


def repetition_coverage(df: DataFrame, text: str, keys: list[str], lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Share of every text that repeats earlier content of the same text.

    Words are runs of letters, runs of digits (all numbers count as equal) and single
    Chinese characters, letter case ignored. A word is covered at length n if it lies in
    a run of n words that occurred earlier in the same text; the first occurrence is not
    covered. ``words_n`` is the share of words, ``chars_n`` that of the words' characters,
    ``lines`` the share of characters in lines that came before.

    Null, empty and wordless texts have n_words 0 and all shares 0. Rows are kept as they
    come, repeated ones too. A text of any length is measured whole. The operator is narrow:
    no shuffle, one pass over the text column.
    """
    out = {"n_words": "bigint"} | {f"{k}_{n}": "double" for n in lengths for k in ("words", "chars")} | {"lines": "double"}
    return map_texts(df, lambda texts: measure(texts, lengths), keys, [text], out)


def repetitive(df: DataFrame, text: str, keys: list[str], n: int = 5, share: float = 0.5, min_words: int = 30) -> DataFrame:
    """Keys of the texts of at least ``min_words`` words of which ``share`` or more is covered at length n; each key once."""
    return repetition_coverage(df, text, keys, (n,)).filter((F.col("n_words") >= min_words) & (F.col(f"words_{n}") >= share)).select(*keys).distinct()
