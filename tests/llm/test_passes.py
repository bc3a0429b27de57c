"""Near duplicates: what goes through the largest shuffle, and pairs left out by counts of cells."""

import random

import numpy as np
import pyarrow as pa

from tracemill.llm import neardup


def _largest_shuffle(spark, job) -> int:
    """Bytes that the stage with the largest shuffle of a job writes."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None))}
    before = stages()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(v for k, v in stages().items() if k not in before)


def test_copies_in_many_tasks_are_sketched_once(spark):
    """Each text has a copy in each of 8 tasks: the bands of one pass are the largest shuffle, some 960 bytes a text."""
    rng = random.Random(41)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(400)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(f"{k}-{i}", t) for k in range(8) for i, t in enumerate(texts)], 8), "id string, body string")

    def job():
        links, members = neardup.similar(df, "body", ["id"], 3, 0.6, 30)
        assert links.count() == 0
        assert members.count() == 3200 and members.select("__id").distinct().count() == 400

    assert _largest_shuffle(spark, job) < 2_500 * len(texts)


def test_counts_of_cells_leave_out_no_link():
    rng = random.Random(43)
    left_out = links = 0
    for size in (1, 5, 40, 300, 3_000):
        texts = []
        for _ in range(25):
            base = [f"w{rng.randrange(9_000)}" for _ in range(size + 2)]
            texts += [" ".join(base), " ".join(base[: rng.randint(size // 2 + 3, size + 2)] if size > 5 else base), " ".join(w if rng.random() > 0.08 else "z" for w in base)]
        doc, h, _ = neardup.shingle_sets(texts, 3)
        n, cells = neardup.cell_counts(doc, h, len(texts))
        sets = [set(h[doc == i].tolist()) for i in range(len(texts))]
        a, b = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
        may = neardup.may_be_similar(n[a], cells[a], n[b], cells[b], 0.6)
        is_link = np.array([len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) for i, j in zip(a, b)])
        assert not (is_link & ~may).any()
        links += is_link.sum()
        left_out += (~may).sum()
    assert links > 400 and left_out > 10_000


def test_texts_that_meet_by_chance_are_no_candidates():
    """Two different texts with one band in common: left out; a large bucket keeps its star, and its members are named."""
    rng = random.Random(47)
    texts = [" ".join(f"w{rng.randrange(9_000)}" for _ in range(90)) for _ in range(6)]
    doc, h, _ = neardup.shingle_sets([*texts, texts[0] + " more"], 3)
    size, cells = neardup.cell_counts(doc, h, 7)
    e = np.zeros(7, neardup.ENTRY)
    e["key"], e["id"], e["size"], e["cells"] = 5, [3, -7, 9, 4, 8, 6, 1], size, cells[:, ::2] << 4 | cells[:, 1::2]
    table = pa.table({"__p": pa.array([0, 0], pa.int32()), "__entries": [e[:3].tobytes(), e[3:].tobytes()]})
    assert neardup._meeting(48, 0.6)(table).to_pylist() == [{"__a": 1, "__b": 3, "__large": False}]
    star = neardup._meeting(3, 0.6)(table).to_pylist()
    assert {(r["__a"], r["__b"], r["__large"]) for r in star} == {(-7, x, True) for x in (1, 3, 4, 6, 8, 9)}
