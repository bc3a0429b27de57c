"""Near-duplicate texts: one-permutation hashing, banded buckets, exact check of candidates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import hashed_words, inside, map_texts, mix64, ngram_hashes, words
from tracemill.llm.components import components
from tracemill.session import materialize

SHINGLE, SIMILARITY, MIN_WORDS = 3, 0.6, 30
BANDS, ROWS, SKETCHES = 64, 5, 4
#: Members up to which a bucket's pairs are all candidates; a larger one has a star, and its members meet by their rarest shingles.
BUCKET = 48
#: Texts of one shingle that meet all others of it under one key.
MEET = 2_000
#: Passes over the sketches, and parts of the keys' range, each of which is met as one.
PASSES, PARTS = 2, 1024
#: Cells by which sets are counted; and what goes through the shuffle for a text and band.
CELLS = 32
ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("size", "<u2"), ("cells", "u1", CELLS // 2)])


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of n words by text: (text index, hash), sorted, and the texts' word counts."""
    w, counts = hashed_words([words(t) for t in texts], stable=True)
    ok = inside(counts, n)
    h = ngram_hashes(w, n)[ok]
    doc = np.repeat(np.arange(len(texts)), counts)[: len(ok)][ok]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[keep], h[keep]
    return doc, h, counts


def one_permutation(doc: np.ndarray, h: np.ndarray, n_docs: int, bins: int, seed: int) -> np.ndarray:
    """The least hash in each of ``bins`` ranges of one permutation, empty bins filled by optimal densification.

    An empty bin takes the value of the first non-empty bin in a sequence drawn from the
    bin and the attempt alone, so equal sets fill alike. Texts without shingles keep zeros.
    """
    out = np.zeros((n_docs, bins), np.uint64)
    if not len(h):
        return out
    p = mix64(h ^ mix64(np.array([seed], np.uint64)))
    cell = doc * bins + ((p >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    out.fill(most)
    np.minimum.at(out.ravel(), cell, p)
    full = out != most
    some = full.any(1)
    out[~full] = 0
    todo_doc, todo_bin = np.nonzero(~full & some[:, None])
    attempt = 1
    while len(todo_doc):
        pick = (mix64(mix64(todo_bin.astype(np.uint64) + np.uint64(1)) ^ np.uint64(attempt * 0x9E37 + seed)) % np.uint64(bins)).astype(np.int64)
        hit = full[todo_doc, pick]
        out[todo_doc[hit], todo_bin[hit]] = out[todo_doc[hit], pick[hit]]
        todo_doc, todo_bin = todo_doc[~hit], todo_bin[~hit]
        attempt += 1
    return out


def bands_of(doc: np.ndarray, h: np.ndarray, n_docs: int, per: int, rows: int, sketches: range) -> np.ndarray:
    """One key per band and text, ``per`` bands from each of the numbered sketches."""
    keys = []
    for s in sketches:
        sketch = one_permutation(doc, h, n_docs, per * rows, 1000 + s).reshape(n_docs, per, rows)
        with np.errstate(over="ignore"):
            key = np.full((n_docs, per), 0, np.uint64)
            for r in range(rows):
                key = mix64(key * np.uint64(0x100000001B3) + sketch[:, :, r])
            keys.append(mix64(key ^ (np.arange(per, dtype=np.uint64) + np.uint64(s * per + 1))))
    return np.concatenate(keys, 1)


def cell_counts(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the size of its set (65535: that or more) and how many members fall into each of CELLS cells.

    Counts are in units of size // 256 + 1, rounded up; 15 stands for that or more.
    """
    size = np.bincount(doc, minlength=n_docs)
    cell = (mix64(h ^ np.uint64(0xC3115)) % np.uint64(CELLS)).astype(np.int64)
    count = np.bincount(doc * CELLS + cell, minlength=n_docs * CELLS).reshape(n_docs, CELLS)
    unit = size // 256 + 1
    return np.minimum(size, 65535).astype(np.uint16), np.minimum(-(-count // unit[:, None]), 15).astype(np.uint8)


def may_be_similar(na: np.ndarray, ca: np.ndarray, nb: np.ndarray, cb: np.ndarray, similarity: float) -> np.ndarray:
    """False only where the sets cannot have that similarity: two sets share no more than the lesser count of each cell."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    most_a = np.where(ca == 15, 1 << 16, ca * (na // 256 + 1)[:, None])
    most_b = np.where(cb == 15, 1 << 16, cb * (nb // 256 + 1)[:, None])
    shared = np.minimum(np.minimum(most_a, most_b).sum(1), np.minimum(na, nb))
    return (shared * (1 + similarity) >= similarity * (na + nb) - 1e-6) | (na == 65535) | (nb == 65535)


def similar(df: DataFrame, text: str, keys: list[str], n: int = 5, similarity: float = 0.8, min_words: int = 1, bands: int = BANDS, rows: int = ROWS, sketches: int = SKETCHES, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the names of every text.

    Returns (links, members). ``members`` is (__id, *keys): every row with a text of at
    least ``min_words`` words (and n), once, and the id of its text; exact copies share an
    id. ``links`` is (__a, __b, similarity): ids of texts whose sets of runs of n words
    have Jaccard ``similarity`` or more, each link once.

    Every different text is written once, however many rows have it. Sketches are
    ``sketches`` one-permutation hashes with optimal densification; ``rows`` bins make a
    band, equal bands a candidate. The sketches are met in PASSES passes, so that only
    the bands of one pass are in a shuffle at a time; an entry of a band is ENTRY's 30
    bytes, packed by Python. A bucket of up to ``bucket`` texts gives those of its pairs
    whose counts by cell allow the similarity (no link is lost by that); a larger one a
    star around its least id, and the texts of all such buckets are joined once more on
    their rarest shingles: two sets of that similarity must share one among the first
    |S| - ceil(similarity |S|) + 1 in any common order. Candidates are then compared
    exactly. At similarity 0.6 the bands find a link with a chance of 0.994, at 0.7 with
    0.99999.

    Null and empty texts have no row; repeated rows are copies with the same name. Copies
    of a text are one row a task before the shuffle and one row after it.
    """
    lower = max(min_words, n)
    row = df.select(*keys, F.col(text).cast("string").alias("__text")).filter("length(__text) > 0").withColumn("__id", F.xxhash64("__text"))
    texts = materialize(row.select("__id", "__text").distinct(), "zstd", tidy=True)
    met = None
    for part in np.array_split(np.arange(sketches), min(PASSES, sketches)):
        entries = map_texts(texts, _entries(n, lower, bands // sketches, rows, range(part[0], part[-1] + 1)), [], ["__id", "__text"], {"__p": "int", "__entries": "binary"})
        pairs = materialize(entries.groupBy("__p").applyInArrow(_meeting(bucket, similarity), "__a bigint, __b bigint, __large boolean"), tidy=True)
        met = pairs if met is None else met.unionByName(pairs)
    enough = met.filter("__b is null").select(F.col("__a").alias("__id")).distinct()
    members = row.select("__id", *keys).distinct().join(enough, "__id", "left_semi")
    candidates = met.filter("__b is not null").select("__a", "__b")
    large = met.filter("__large").select(F.explode(F.array("__a", "__b")).alias("__id")).distinct()
    if not large.isEmpty():
        candidates = candidates.unionByName(_rare_pairs(_sets(texts, large, n), similarity))
    candidates = materialize(candidates.distinct(), tidy=True)
    wanted = candidates.select(F.explode(F.array("__a", "__b")).alias("__id")).distinct()
    sets = materialize(_sets(texts, wanted, n), tidy=True)
    both = candidates.join(sets.select(F.col("__id").alias("__a"), F.col("__set").alias("__sa")), "__a").join(sets.select(F.col("__id").alias("__b"), F.col("__set").alias("__sb")), "__b")
    common = F.size(F.array_intersect("__sa", "__sb"))
    links = both.select("__a", "__b", (common / (F.size("__sa") + F.size("__sb") - common)).alias("similarity")).filter(F.col("similarity") >= similarity)
    return links.distinct(), members


def _entries(n: int, lower: int, per: int, rows: int, sketches: range):
    """Of a list of texts: a row for each part of the keys' range, with the packed entries of its bands, and the ids of all with enough words in a row of part -1."""

    def run(ids: list[str], texts: list[str]) -> list:
        doc, h, counts = shingle_sets(texts, n)
        long = counts >= lower
        keep = long[doc]
        doc, h = (np.cumsum(long) - 1)[doc[keep]], h[keep]
        name = np.array(ids, np.int64)[long]
        key = bands_of(doc, h, len(name), per, rows, sketches).ravel()
        size, cells = cell_counts(doc, h, len(name))
        made = np.zeros(len(key), ENTRY)
        width = per * len(sketches)
        made["key"], made["id"], made["size"] = key & np.uint64(0xFFFFFFFF), np.repeat(name, width), np.repeat(size, width)
        made["cells"] = np.repeat(cells[:, ::2] << 4 | cells[:, 1::2], width, 0)
        part = (key >> np.uint64(32)) % np.uint64(PARTS)
        order = np.argsort(part, kind="stable")
        part, made = part[order], made[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
        return [[-1, *part[first].tolist()], [name.tobytes(), *(made[a:b].tobytes() for a, b in zip(first, [*first[1:], len(made)]))]]

    return run


def _meeting(bucket: int, similarity: float):
    """The pairs of ids that meet in the bands of one part; the ids of part -1 as pairs with null."""

    def run(table: pa.Table) -> pa.Table:
        packed = b"".join(table.column("__entries").to_pylist())
        if table.column("__p")[0].as_py() < 0:
            name = np.unique(np.frombuffer(packed, np.int64))
            return _pairs_table(name, None, np.zeros(len(name), bool))
        e = np.frombuffer(packed, ENTRY)
        e = e[np.lexsort((e["id"], e["key"]))]
        key, name, size = e["key"], e["id"], e["size"]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(begins, len(e)))
        own = np.repeat(many, many)
        least = np.repeat(name[begins], many)
        far = (own > bucket) & (name != least)
        a, b, large = [least[far]], [name[far]], [np.ones(far.sum(), bool)]
        left = np.flatnonzero((own > 1) & (own <= bucket))
        cells = np.stack([e["cells"] >> 4, e["cells"] & 15], 2).reshape(len(e), CELLS)
        for step in range(1, int(many[many <= bucket].max(initial=1))):
            i = left[left + step < len(e)]
            i = i[key[i] == key[i + step]]
            i = i[may_be_similar(size[i], cells[i], size[i + step], cells[i + step], similarity)]
            a.append(name[i])
            b.append(name[i + step])
            large.append(np.zeros(len(i), bool))
        return _pairs_table(np.concatenate(a), np.concatenate(b), np.concatenate(large))

    return run


def _pairs_table(a: np.ndarray, b: np.ndarray | None, large: np.ndarray) -> pa.Table:
    return pa.table({"__a": a, "__b": pa.nulls(len(a), pa.int64()) if b is None else b, "__large": large})


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(__id, __set): the shingle hashes of the wanted texts."""

    def sets(lists: list[str | None]) -> list:
        doc, h, _ = shingle_sets(lists, n)
        cut = np.searchsorted(doc, np.arange(len(lists) + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))]

    return map_texts(texts.join(wanted, "__id", "left_semi"), sets, ["__id"], ["__text"], {"__set": "array<bigint>"})


def _rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of texts that share one of the shingles that come first by rarity (then by value).

    Texts meet by shingle and band of set size (sizes of similar sets differ by a factor
    of 1 / similarity at most, so by one band). The texts of a shingle in more than MEET
    of them are dealt out over as many keys as it has multiples of MEET, each of which
    meets all of its texts: a hot shingle is work for many tasks.
    """
    flat = materialize(sets.select("__id", F.size("__set").alias("__n"), F.explode("__set").alias("__s")).distinct())
    often = flat.groupBy("__s").agg(F.count("*").alias("__df")).filter("__df > 1")
    ranked = flat.join(often, "__s", "left").withColumn("__r", F.row_number().over(Window.partitionBy("__id").orderBy(F.coalesce("__df", F.lit(1)), "__s")))
    prefix = ranked.filter(F.col("__df").isNotNull() & (F.col("__r") <= F.col("__n") - F.ceil(F.col("__n") * similarity - 1e-9) + 1))
    band = F.floor(F.log(F.col("__n")) / -math.log(similarity)) if similarity < 1 else F.col("__n").cast("bigint")
    parts = F.ceil(F.col("__df") / MEET).cast("int")
    prefix = materialize(prefix.select("__s", "__id", "__n", band.alias("__band"), parts.alias("__parts")))
    a = prefix.select("__s", "__band", F.pmod(F.xxhash64("__id"), "__parts").cast("int").alias("__part"), F.col("__id").alias("__a"), F.col("__n").alias("__na"))
    near = F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1))
    b = prefix.select("__s", near.alias("__band"), "__parts", F.col("__id").alias("__b"), F.col("__n").alias("__nb"))
    b = b.select("__s", "__band", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "__b", "__nb")
    fits = (F.least("__na", "__nb") >= F.greatest("__na", "__nb") * similarity - 1e-9) & (F.col("__a") < F.col("__b"))
    return a.join(b, ["__s", "__band", "__part"]).filter(fits).select("__a", "__b").distinct()


def _sides(pairs: DataFrame) -> DataFrame:
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_solution").alias("solution")) for s in ("chosen", "rejected")]))
    return pairs.select("pair_id", side.alias("__s")).select("pair_id", "__s.side", "__s.solution")


def similar_solutions(pairs: DataFrame) -> DataFrame:
    """Matching solution texts by their names: (pair_id_a, side_a, pair_id_b, side_b), the smaller name first, each pair once.

    A link between two texts is given for every name of both. Equal texts under several
    names are a group of exact copies and not expanded into pairs: each further name has
    one row, with the least name of its text. ``solution_groups`` has the links between
    texts without names, and the groups.
    """
    links, members = similar(_sides(pairs), "solution", ["pair_id", "side"], SHINGLE, SIMILARITY, MIN_WORDS)
    named = materialize(members.select("__id", F.struct("pair_id", "side").alias("name")))
    a = named.select(F.col("__id").alias("__a"), F.col("name").alias("x"))
    b = named.select(F.col("__id").alias("__b"), F.col("name").alias("y"))
    linked = links.join(a, "__a").join(b, "__b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    least = named.groupBy("__id").agg(F.min("name").alias("x"), F.max("name").alias("__most")).filter(F.col("x") != F.col("__most")).drop("__most")
    copies = named.join(least, "__id").filter(F.col("x") != F.col("name")).select("x", F.col("name").alias("y"))
    both = linked.unionByName(copies)
    return both.select(F.col("x.pair_id").alias("pair_id_a"), F.col("x.side").alias("side_a"), F.col("y.pair_id").alias("pair_id_b"), F.col("y.side").alias("side_b"))


def solution_groups(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, text_id, links, group_id): a row per solution of enough words with its text, its number of linked texts and its group.

    Copies have the same text_id; texts joined by links, also through others, have the
    same group_id, which is a text_id of the group.
    """
    links, members = similar(_sides(pairs), "solution", ["pair_id", "side"], SHINGLE, SIMILARITY, MIN_WORDS)
    links = materialize(links)
    degree = links.select(F.explode(F.array("__a", "__b")).alias("__id")).groupBy("__id").agg(F.count("*").alias("links"))
    label = components(links, "__a", "__b").select(F.col("vertex").alias("__id"), "label")
    return members.join(degree, "__id", "left").join(label, "__id", "left").select("pair_id", "side", F.col("__id").alias("text_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "__id").alias("group_id"))
