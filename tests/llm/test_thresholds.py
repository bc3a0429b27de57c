"""Thresholds of the end model come from all rows, however small the sample its counts are from."""

import random

import numpy as np

from tracemill.llm import truncation
from tracemill.llm.language import vote

GERMAN = ["Wir lesen die Zahlen aus der Tafel und zählen sie zusammen.", "Das Ergebnis ist {} und es gilt auch für die nächste Reihe.", "Nun folgt noch der letzte Teil mit {} Schritten."]
ENGLISH = ["We read the numbers from the table and add them up.", "The result is {} and it holds for the next row.", "Then comes the last part with {} steps."]


def _texts(kind, n, rng):
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(kind).format(rng.randrange(99)) for _ in range(6))
        out.append(t if rng.random() < 0.8 else t[: rng.randrange(60, len(t))])
    return out


def test_thresholds_cover_rows_outside_the_sample(spark):
    rng = random.Random(3)
    rows = [(t, c) for kind, n in ((ENGLISH, 900), (GERMAN, 400)) for c in ("a", "b") for t in _texts(kind, n, rng)]
    df = spark.createDataFrame(rows, "t string, c string").repartition(5)
    model = truncation.fit_on_sample(df, "t", "c", max_texts=200)
    assert {("en", "a"), ("en", "b"), ("de", "a"), ("de", "b"), ("", "a"), ("", "b"), ("", "")} <= set(model.threshold)

    texts, columns = zip(*rows)
    score = model.score([truncation.uncut(t)[0] for t in texts])
    langs = [vote(t) for t in texts]
    for (lang, c), got in model.threshold.items():
        x = np.array([s for s, l, k in zip(score, langs, columns) if lang in ("", l) and c in ("", k)])
        near = np.array([(np.abs(x - t) < 0.5).sum() for t in np.linspace(-2.0, 1.0, 31)]) + np.abs(np.linspace(-2.0, 1.0, 31) + 0.3) * 0.5
        assert len(x) >= 300 and got == np.linspace(-2.0, 1.0, 31)[near.argmin()]
