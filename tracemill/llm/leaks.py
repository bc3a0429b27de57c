"""Evaluation passages inside training text: Wu-Manber multi-pattern search over words.

Patterns are all runs of ``run`` words of the test items. A table over blocks of words says
how far the search may jump: a block that no pattern holds lets it pass by a whole pattern.
Where the jump is zero, the block's bucket names the patterns that end in it, and direct
comparison confirms them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import INVISIBLE, WORD, map_texts

RUN, BLOCK = 12, 3
#: Characters of test items in one broadcast search table; more items are searched in further passes.
PASS_CHARS = 8_000_000
#: Items that must close with the same sentence for it to be an instruction rather than part of the question.
INSTRUCTION_ITEMS = 5
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?\w{1,8};|\\[A-Za-z]+")
_SENTENCE = re.compile(r"(?<=[.?!。？！])\s+")


def plain_words(text: str | None) -> list[str]:
    """Words of a text without markup and invisible characters, compatibility forms unified, letter case ignored."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "\\" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return WORD.findall(text.casefold())


def item_bodies(items: list[tuple[str, str | None]], shared: int = INSTRUCTION_ITEMS) -> dict[str, list[str]]:
    """Words of each test item before its closing instruction: a last sentence that at least ``shared`` items close with."""
    split = {k: _SENTENCE.split(t.strip()) for k, t in items if k is not None and t}
    often: dict[str, int] = defaultdict(int)
    for s in split.values():
        if len(s) > 1:
            often[" ".join(plain_words(s[-1]))] += 1
    out = {}
    for k, s in split.items():
        if len(s) > 1 and often[" ".join(plain_words(s[-1]))] >= shared:
            s = s[:-1]
        out[k] = plain_words(" ".join(s))
    return out


class WuManber:
    def __init__(self, bodies: dict[str, list[str]], run: int = RUN, block: int = BLOCK):
        self.run, self.block, self.bodies = run, block, bodies
        self.jump: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for item, w in bodies.items():
            if len(w) < run:
                continue
            for end in range(block, len(w) + 1):
                key = tuple(w[end - block : end])
                gap = max(0, run - end)  # words until the first pattern that holds this block there ends
                if gap < self.jump.get(key, run):
                    self.jump[key] = gap
                if end >= run:
                    self.bucket[key].append((item, end))

    def runs(self, words: list[str]) -> list[tuple[str, int, int]]:
        """Maximal common runs as (item, start, end) of at least ``run`` words."""
        run, block, jump, n = self.run, self.block, self.jump, len(words)
        far = run - block + 1
        out: list[tuple[str, int, int]] = []
        reached: dict[tuple[str, int], int] = {}
        at = run
        while at <= n:
            key = tuple(words[at - block : at])
            step = jump.get(key, far)
            if step:
                at += step
                continue
            for item, end in self.bucket[key]:
                body = self.bodies[item]
                if reached.get((item, end - at), -1) >= at or body[end - run : end] != words[at - run : at]:
                    continue
                a, b = at - run, at
                i, j = end - run, end
                while a and i and words[a - 1] == body[i - 1]:
                    a, i = a - 1, i - 1
                while b < n and j < len(body) and words[b] == body[j]:
                    b, j = b + 1, j + 1
                reached[item, end - at] = b
                out.append((item, a, b))
            at += 1
        return out


def _own(runs: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The runs that no other item holds, too."""
    return [r for r in runs if not any(o[0] != r[0] and o[1] <= r[1] and o[2] >= r[2] for o in runs)]


def leaked_passages(records: DataFrame, text: str, keys: list[str], items: DataFrame, item_id: str = "unique_id", item_text: str = "problem", run: int = RUN) -> DataFrame:
    """(keys, item id, start_word, n_words): maximal runs of at least ``run`` words that a record shares with one test item only.

    Markup, punctuation, spacing, letter case and invisible characters do not count; the
    words of a closing instruction sentence that at least five items share are not part of
    an item. Null and short records and items give nothing; a run is given once for each
    row that holds it. Records are searched whole in one narrow pass for each PASS_CHARS of test items, and
    each pass broadcasts a table of that bounded size. Runs found in several passes
    are weighed against each other by a join on the record.
    """
    spark = records.sparkSession
    own = items.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).cast("string").alias("t")).dropDuplicates()
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    kind = items.schema[item_id].dataType.simpleString()
    out = {"__item": "string", "__start": "int", "__end": "int"}
    found = None
    shared = _shared_closings(own) if passes > 1 else None
    for p in range(passes):
        part = own.filter(F.pmod(F.xxhash64("k"), F.lit(passes)) == p) if passes > 1 else own
        bodies = item_bodies([(r.k, r.t) for r in part.collect()]) if shared is None else {k: w for k, w in _bodies_given(part.collect(), shared)}
        sent = spark.sparkContext.broadcast(WuManber(bodies, run))

        def search(texts: list[str | None], sent=sent, alone: bool = passes == 1) -> list:
            rows, item, start, end = [], [], [], []
            m = sent.value
            for i, t in enumerate(texts):
                w = plain_words(t)
                if len(w) < m.run:
                    continue
                got = m.runs(w)
                for k, a, b in _own(got) if alone and len(got) > 1 else got:
                    rows.append(i), item.append(k), start.append(a), end.append(b)
            return [rows, item, start, end]

        one = map_texts(records, search, keys, [text], out, explode=True)
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        a, b = found.alias("a"), found.alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        cover = (F.col("a.__item") != F.col("b.__item")) & (F.col("b.__start") <= F.col("a.__start")) & (F.col("b.__end") >= F.col("a.__end"))
        on = cover
        for c in same:
            on = on & c
        found = a.join(b, on, "left_anti").select("a.*")
    return found.select(*keys, F.col("__item").cast(kind).alias(item_id), F.col("__start").alias("start_word"), (F.col("__end") - F.col("__start")).alias("n_words"))


def _shared_closings(own: DataFrame) -> set[str]:
    """Closing sentences of many items; at most items / INSTRUCTION_ITEMS, and in practice a handful."""
    closing = map_texts(own, lambda texts: [[" ".join(plain_words(s[-1])) if len(s := _SENTENCE.split((t or "").strip())) > 1 else None for t in texts]], ["k"], ["t"], {"c": "string"})
    return {r.c for r in closing.filter("c is not null").groupBy("c").count().filter(F.col("count") >= INSTRUCTION_ITEMS).select("c").collect()}


def _bodies_given(rows: list, shared: set[str]):
    for r in rows:
        if r.k is not None and r.t:
            s = _SENTENCE.split(r.t.strip())
            if len(s) > 1 and " ".join(plain_words(s[-1])) in shared:
                s = s[:-1]
            yield r.k, plain_words(" ".join(s))


def leaked_records(problems: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(record_table, record_id, unique_id), each once: questions and documents that hold a passage of a test item."""
    records = problems.select(F.lit("problems").alias("record_table"), F.col("problem_id").alias("record_id"), F.col("question").alias("__record")).unionByName(documents.select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("__record")))
    return leaked_passages(records, "__record", ["record_table", "record_id"], items).select("record_table", "record_id", "unique_id").distinct()
