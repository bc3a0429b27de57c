"""Structures that a model gives as JSON: salvage, cleaned graphs, liveness and rewards of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators.rir import reach
from tracemill.operators.traces import conclusion_ids, once

REPLY = "struct<steps: array<struct<id: int, type: string, content: string, inputs: array<int>>>>"


def salvage(reply: Column, schema: str = REPLY) -> Column:
    """What stands between the first and the last brace of a reply, read as JSON; null where that is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), schema)


def parse_replies(df: DataFrame, reply: str, first_id: int = 0) -> DataFrame:
    """Adds parse_success, steps, edges, conclusions and live, as text analysis gives them, from a column of replies.

    Steps without an id have their place (from ``first_id``). Inputs that name no step, or
    the step itself, are dropped; the rest become places, so cycles and forward inputs may
    remain, which liveness follows. Without a conclusion the last step is one. A reply
    that is null, holds no JSON or no steps has empty arrays and parse_success false.
    """
    raw = F.coalesce(salvage(F.col(reply))["steps"], F.from_json(F.lit("[]"), "array<struct<id: int, type: string, content: string, inputs: array<int>>>"))
    df = df.withColumn("__raw", once(raw))
    ids = F.transform("__raw", lambda s, i: F.coalesce(s["id"], i + first_id))
    none = F.array().cast("array<int>")

    def places(s: Column, i: Column) -> Column:
        own = F.element_at(F.col("__ids"), i + 1)
        known = F.filter(F.coalesce(s["inputs"], none), lambda x: F.array_contains("__ids", x) & (x != own))
        return F.transform(known, lambda x: F.array_position("__ids", x).cast("int") - 1)

    def step(s: Column, i: Column) -> Column:
        content = F.coalesce(s["content"], F.lit(""))
        return F.struct(i.alias("id"), F.coalesce(s["type"], F.lit("derivation")).alias("step_type"), content.alias("content"), F.length(content).alias("char_length"), text.symbols(content).alias("sym"))

    df = df.withColumn("__ids", once(ids)).withColumn("edges", once(F.transform("__raw", places))).withColumn("steps", once(F.transform("__raw", step)))
    nodes = F.transform("steps", lambda s, i: F.struct(s["id"].alias("id"), s["step_type"].alias("type"), F.element_at(F.col("edges"), i + 1).alias("inputs")))
    df = df.withColumn("conclusions", conclusion_ids(F.col("steps"))).withColumn("__nodes", once(nodes)).withColumn("live", once(reach(F.col("__nodes"))))
    return df.withColumn("parse_success", F.size("steps") > 0).drop("__raw", "__ids", "__nodes")


def as_reply(steps: Column, edges: Column, first_id: int = 0) -> Column:
    """Steps and their inputs as the JSON such a model gives."""
    rows = F.transform(steps, lambda s, i: F.struct((s["id"] + first_id).alias("id"), s["step_type"].alias("type"), s["content"].alias("content"), F.transform(F.element_at(edges, i + 1), lambda k: k + first_id).alias("inputs")))
    return F.to_json(F.struct(rows.alias("steps")))


def graph_json(steps: Column, edges: Column, live: Column) -> Column:
    """A graph as JSON: every step with its type, inputs, outputs and liveness."""

    def node(s: Column, i: Column) -> Column:
        users = F.filter(F.sequence(F.lit(0), F.size(steps) - 1), lambda j: F.array_contains(F.element_at(edges, j + 1), i))
        return F.struct(i.alias("step_id"), s["step_type"].alias("step_type"), F.element_at(edges, i + 1).alias("inputs"), users.alias("outputs"), F.array_contains(live, i).alias("is_live"))

    return F.to_json(F.struct(F.transform(steps, node).alias("nodes")))
