"""What an online observer would see: every prefix of a trace, its motifs and the intervention they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.motifs import with_motifs
from tracemill.operators.traces import KEYS, conclusion_ids, live_ids, once, unique

KINDS = ["redirect_cascade", "skip_theater", "redirect_branch"]


def prefixes(p: DataFrame) -> DataFrame:
    """A row per prefix with its own liveness and motifs; edges do not change as a trace grows, only the conclusions do.

    Steps are cut down to what motifs look at first, so no prefix carries text.
    """
    bare = F.transform("steps", lambda s: F.struct(s["id"].alias("id"), s["step_type"].alias("step_type"), s["sym"].alias("sym")))
    p = p.select(*KEYS, "edges", once(bare).alias("steps"))
    ends = F.when(F.size("steps") > 0, F.sequence(F.lit(1), F.size("steps"))).otherwise(F.array().cast("array<int>"))
    x = p.select(*KEYS, F.explode(F.transform(ends, lambda k: F.struct(k.alias("n"), F.slice(F.col("steps"), F.lit(1), k).alias("steps"), F.slice(F.col("edges"), F.lit(1), k).alias("edges")))).alias("x")).select(*KEYS, "x.*")
    x = x.withColumn("conclusions", conclusion_ids(F.col("steps"))).withColumn("live", once(live_ids(F.col("edges"), F.col("conclusions"))))
    return with_motifs(x)


def timeline(p: DataFrame) -> DataFrame:
    """Per prefix: its last step, steps, motifs, dead-step ratio and the intervention, if any.

    A dead run of three or more that reaches the step before the last calls for a redirect,
    else theater at the last step for a skip, else an abandoned branch of three or more at
    the last step for a redirect.
    """
    last = F.col("n") - 1
    end = lambda m: m["first_id"] + m["length"] - 1
    cascade = F.filter("motifs", lambda m: (m["motif_type"] == "dead_cascade") & (end(m) >= last - 1) & (m["length"] >= 3))
    theater = F.exists("motifs", lambda m: (m["motif_type"] == "verification_theater") & (m["first_id"] <= last) & (end(m) >= last))
    branch = F.exists("motifs", lambda m: (m["motif_type"] == "abandoned_branch") & (m["first_id"] <= last) & (end(m) >= last) & (m["length"] >= 3))
    kind = F.when(F.size(cascade) > 0, KINDS[0]).when(theater, KINDS[1]).when(branch, KINDS[2])
    rows = prefixes(p).select(*KEYS, last.alias("step_id"), F.col("n").alias("num_steps"), F.size("motifs").alias("num_motifs"), (F.col("n") - F.size("live")).alias("num_dead"), kind.alias("intervention"))
    return unique(rows, "step_id")


def interventions(p: DataFrame) -> DataFrame:
    return timeline(p).filter("intervention is not null")
