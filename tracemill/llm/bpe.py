"""Byte-pair encoding of a corpus by a public rank file: backtracking over longest matches.

The greedy longest match of the vocabulary at a place is what the merges give unless two
neighbouring tokens could not stand side by side; a table of compatible pairs decides
that, and a refused token is replaced by its longest proper prefix, going back one token
where none is left. Every place is given up at most once, so the time is linear.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's publisher splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a worker keeps; beyond it the store starts anew.
STORE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in id order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class BacktrackingEncoder:
    """Exact merges of a byte-level vocabulary whose ids are merge ranks."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.size = [len(t) for t in tokens]
        ids = {t: i for i, t in enumerate(tokens)}
        self.find = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        self.prefix = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self.made: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            left, split = self.prefix[i], (i, i)
            while left >= 0:
                right = ids.get(t[self.size[left] :], i)
                if left < i and right < i and self.compatible(left, right):
                    self.made[left, right] = i
                    split = (left, right)
                    break
                left = self.prefix[left]
            self.parts.append(split)
        self.store: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side.

        Undo merges from the youngest on: if the touching pieces could have merged
        before the merge that hides them, the pair cannot stand.
        """
        limit = len(self.tokens) + 1
        while True:
            if self.made.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest, size = [-1] * n, self.size
        for end, token in self.find.iter(piece.decode("latin-1")):
            start = end - size[token] + 1
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        free = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if free[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                if self.prefix[token] >= 0:
                    token = self.prefix[token]
                    continue
                free[at] = 0
                out.pop()
                at -= size[last]
                token = last
                break
        return out

    def pieces(self, text: str) -> list[str]:
        return _splitter().findall(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        store = self.store
        for piece in self.pieces(text):
            got = store.get(piece)
            if got is None:
                if len(store) >= STORE:
                    store.clear()
                got = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    store[piece] = got
            out += got
        return out


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def _encoder(path: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(read_ranks(path))


_SHIPPED: dict[int, BacktrackingEncoder] = {}


def _from_broadcast(sent) -> BacktrackingEncoder:
    if sent.id not in _SHIPPED:
        _SHIPPED.clear()
        _SHIPPED[sent.id] = BacktrackingEncoder(sent.value)
    return _SHIPPED[sent.id]


class _Sent:
    """A broadcast vocabulary (its size is that of the rank file, under 1 MB) with a name that workers can keep it by."""

    def __init__(self, spark, path: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(read_ranks(path)), hash((path, os.path.getmtime(path)))

    @property
    def value(self) -> list[bytes]:
        return self.broadcast.value


def _packed(lists: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, text: str, keys: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and ``ids``: the token ids of every text by a byte-level rank file, without special tokens.

    Empty and null texts have an empty list. Strings that look like special tokens are
    ordinary text. Repeated rows stay. Narrow: the vocabulary (a fixed file) is broadcast,
    each worker builds its tables once and keeps the ids of recent pre-tokens.
    """
    sent = _Sent(df.sparkSession, os.path.join(folder, vocabulary))

    def run(texts: list[str | None]) -> list:
        e = _from_broadcast(sent)
        return [_packed([e.encode(t) for t in texts])]

    return map_texts(df, run, keys, [text], {"ids": "array<int>"})


def count_tokens(df: DataFrame, text: str, keys: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and ``n_tokens`` of every text; 0 for empty and null."""
    sent = _Sent(df.sparkSession, os.path.join(folder, vocabulary))

    def run(texts: list[str | None]) -> list:
        e = _from_broadcast(sent)
        return [[len(e.encode(t)) for t in texts]]

    return map_texts(df, run, keys, [text], {"n_tokens": "bigint"})


class Decoder:
    """All tokens' bytes in one block with an offset table; a list of ids is gathered in one step."""

    def __init__(self, tokens: list[bytes]):
        self.block = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: list[int] | None) -> bytes:
        if not ids:
            return b""
        i = np.asarray(ids)
        size = self.starts[i + 1] - self.starts[i]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[i] - (ends - size), size)
        return self.block[at].tobytes()


def decode(df: DataFrame, ids: str, keys: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys and ``decoded``: the text of each list of ids, '' for empty and null lists; bytes that are no UTF-8 become U+FFFD."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = {k: kinds[k] for k in keys} | {"decoded": "string"}
    sent = _Sent(df.sparkSession, os.path.join(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(sent.value)
        for b in batches:
            out = [d.decode(x).decode("utf-8", "replace") for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(out, pa.string())], names=list(columns))

    return df.select(*keys, F.col(ids).alias("__ids")).mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in columns.items()))
