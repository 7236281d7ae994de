"""Summaries checked against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.schemas import VERIFICATION


def pairs(nodes: DataFrame, edges: DataFrame, trees: DataFrame) -> DataFrame:
    """``doc_id, root_id, summary, source``: each root's text and the texts of its direct children."""
    root = trees.join(nodes.select("doc_id", F.col("node_id").alias("root_id"), F.col("text").alias("summary")), ["doc_id", "root_id"])
    kids = edges.join(nodes.select("doc_id", F.col("node_id").alias("child_id"), "text"), ["doc_id", "child_id"])
    x = root.join(kids.select("doc_id", F.col("parent_id").alias("root_id"), "ord", "text"), ["doc_id", "root_id"])
    g = x.groupBy("doc_id", "root_id", "summary").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return g.select("doc_id", "root_id", "summary", F.array_join(F.transform("x", lambda s: F.coalesce(s["text"], F.lit(""))), "\n\n").alias("source"))


def parse(reply: Column, model: str) -> Column:
    """A model's reply as a verification struct; null where it is not valid JSON."""
    v = F.from_json(T.strip_fence(reply), VERIFICATION, {"mode": "PERMISSIVE"})
    ok = v["score"].isNotNull()
    return F.when(
        ok,
        F.struct(
            v["score"].alias("score"), F.coalesce(v["details"], F.array()).alias("details"), F.coalesce(v["unsupported_claims"], F.array()).alias("unsupported_claims"),
            F.coalesce(v["model_name"], F.lit(model)).alias("model_name"),
        ),
    )


def mock(summary: Column, source: Column) -> Column:
    """The deterministic verifier: nothing to check scores 0, everything else 1."""
    none = F.array().cast("array<struct<claim:string,verdict:string,reasoning:string>>")
    empty = summary.isNull() | source.isNull() | (F.length(summary) == 0) | (F.length(source) == 0)
    skipped = F.struct(F.lit(0.0).alias("score"), none.alias("details"), F.array(F.lit("Empty Input")).alias("unsupported_claims"), F.lit("Skipped").alias("model_name"))
    passed = F.struct(F.lit(1.0).alias("score"), none.alias("details"), F.array().cast("array<string>").alias("unsupported_claims"), F.lit("Mock").alias("model_name"))
    return F.when(empty, skipped).otherwise(passed)


def supported(details: Column) -> Column:
    """Whether each claim's verdict is Supported, however it is spelled."""
    return F.transform(details, lambda d: F.lower(F.trim(F.coalesce(d["verdict"], F.lit("")))) == "supported")
