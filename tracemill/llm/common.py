"""Shared pieces of the text operators: Arrow batches, word hashes, answers as rows."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once inside one Arrow batch; bounds a worker's memory, not the text: a longer text is a chunk of its own.
CHUNK_CHARS = 1_500_000

WORD = re.compile(r"[^\W_]+")
#: Soft hyphens, zero-width characters, direction marks and the like.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
#: Runs of digits, single Chinese characters, runs of other letters.
WORD_OR_HAN = re.compile(rf"\d+|[{HAN}]|[^\W\d_{HAN}]+")

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, letter case ignored; none for null."""
    return WORD.findall(text.casefold()) if text else []


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Spans of the list that hold about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(batch: pa.RecordBatch, first: int, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Spans of a batch whose string columns from ``first`` on hold about ``limit`` bytes each, told by their offsets."""
    size = np.zeros(batch.num_rows, np.int64)
    for i in range(first, batch.num_columns):
        size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def schema_of(columns: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in columns.items())


def batch_of(columns: dict[str, str], data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, _ARROW[kind]) for x, kind in zip(data, columns.values())], names=list(columns))


def map_texts(df: DataFrame, fn: Callable[..., list], keys: list[str], texts: list[str], out: dict[str, str], explode: bool = False) -> DataFrame:
    """Run ``fn`` over chunks of text columns in Arrow batches, carrying the key columns along.

    ``fn(*lists of texts)`` returns one list (or Arrow array) for each column of
    ``out``, in row order; with ``explode`` its first element holds the row number
    of each output row instead. Only keys and texts are read from ``df``, so extra
    or clashing columns of the input are without effect.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = {k: kinds[k] for k in keys} | out
    n_keys, n_texts = len(keys), len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in spans(batch, n_keys):
                part = batch.slice(a, b - a)
                got = fn(*[part.column(n_keys + i).to_pylist() for i in range(n_texts)])
                own = [part.column(i) for i in range(n_keys)]
                if explode:
                    rows = pa.array(got[0], pa.int64())
                    own, got = [x.take(rows) for x in own], got[1:]
                yield batch_of(columns, [*own, *got])

    picked = df.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`").cast("string").alias(f"__text{i}") for i, c in enumerate(texts)])
    return picked.mapInArrow(run, schema_of(columns))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def hashed_words(lists: list[list[str]], stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one array, and each text's word count.

    The quick hash differs from process to process and serves comparisons inside
    one batch; ``stable`` gives the same number everywhere.
    """
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = list(itertools.chain.from_iterable(lists))
    if stable:
        from hashlib import blake2b

        seen: dict[str, int] = {}
        for w in set(flat):
            seen[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        values = np.fromiter(map(seen.__getitem__, flat), np.uint64, len(flat))
    else:
        values = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    return mix64(values), counts


def prefix_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling sums of one array of word hashes, from which the hash of a run of any length is one difference; and what takes a run's place out of it."""
    n = len(words)
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])]), down


def ngram_hashes(words: np.ndarray, n: int, prefix: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Polynomial hashes of every run of n words of one array, texts' borders ignored; ``prefix`` serves all lengths."""
    m = len(words) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    total, down = prefix or prefix_hashes(words)
    with np.errstate(over="ignore"):
        return mix64((total[n:] - total[:m]) * down[:m])


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n words of the joined texts: whether it lies inside one text."""
    total = int(counts.sum())
    m = max(0, total - n + 1)
    ends = np.repeat(np.cumsum(counts), counts)[:m]
    return np.arange(m) + n <= ends


def traces(rollouts: DataFrame) -> DataFrame:
    """One row per sampled trace: rollout_id, trace_id (its place), shard, problem_text, solution, num_tokens.

    Null or empty ``traces`` give no row; a null trace is a trace with null fields.
    """
    return rollouts.select("rollout_id", "shard", "problem_text", F.posexplode("traces").alias("trace_id", "__t")).select(
        "rollout_id", "trace_id", "shard", "problem_text", F.col("__t.solution").alias("solution"), F.col("__t.num_tokens").alias("num_tokens")
    )


def answers(rollouts: DataFrame, pairs: DataFrame, slots: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """Every solution text as (record_table, record_id, slot, problem_text, solution, num_tokens); pairs come without token counts."""
    own = traces(rollouts).select(F.lit("rollouts").alias("record_table"), F.col("rollout_id").alias("record_id"), F.col("trace_id").cast("string").alias("slot"), "problem_text", "solution", "num_tokens")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"{s}_solution").alias("solution")) for s in slots]))
    other = pairs.select(F.col("pair_id").alias("record_id"), "problem_text", sides.alias("__s")).select(F.lit("preference_pairs").alias("record_table"), "record_id", F.col("__s.slot").alias("slot"), "problem_text", F.col("__s.solution").alias("solution"), F.lit(None).cast("int").alias("num_tokens"))
    return own.unionByName(other)


LONG = T.LongType()
