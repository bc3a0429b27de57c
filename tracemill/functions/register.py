"""SQL names: a table function of a text's steps, and temporary views of the spine."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from tracemill.functions import fixed
from tracemill.operators import traces

_WEIGHTED = [("verification", 2.0, True, fixed.VERIFICATION), ("exploration", 1.5, True, fixed.EXPLORATION), ("correction", 1.5, True, fixed.CORRECTION), ("computation", 1.0, False, fixed.COMPUTATION)]


def plain_step_type(paragraph: str) -> str:
    """The type of one paragraph in plain Python; the Column function of that name gives the same."""
    if "\\boxed{" in paragraph or "\\boxed " in paragraph:
        return "conclusion"
    best, most = "derivation", 2.0
    for kind, weight, lowered, patterns in _WEIGHTED:
        text = paragraph.lower() if lowered else paragraph
        score = weight * sum(re.search(p, text) is not None for p in patterns)
        if score > most or (score == most and best == "derivation"):
            best, most = kind, score
    return best


@udtf(returnType="step_id int, step_type string, char_length int")
class TraceSteps:
    """``select * from trace_steps(text)``: the steps of one text; none for null and blank.

    A convenience for SQL over few texts. Over tables use the view ``trace_rows``, which
    stays in the JVM.
    """

    def eval(self, text: str) -> Iterator[tuple[int, str, int]]:
        parts = [p.strip() for p in re.split(r"\n\n+", text or "")]
        for i, p in enumerate(x for x in parts if x):
            yield i, plain_step_type(p), len(p)


def register(spark: SparkSession, rollouts: DataFrame | None = None) -> None:
    """The table function ``trace_steps``, and with a rollout table the temporary views ``traces``, ``trace_rows`` (steps) and ``trace_metrics``."""
    spark.udtf.register("trace_steps", TraceSteps)
    if rollouts is not None:
        flat = traces.flatten(rollouts)
        flat.createOrReplaceTempView("traces")
        p = traces.parse(flat)
        traces.exploded(p).createOrReplaceTempView("trace_rows")
        traces.annotate(p).createOrReplaceTempView("trace_metrics")
