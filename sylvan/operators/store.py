"""The node store as tables: keyed upserts, narrow updates, lookups by join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both, the last by ``order`` for each key (later batches win ties)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.col("_batch").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_batch")


def last_version(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def update_embeddings(nodes: DataFrame, updates: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """``nodes`` with new vectors where ``updates`` has one; null updates and unknown keys change nothing."""
    u = updates.where(F.col(column).isNotNull()).select(key, F.col(column).alias("_new")).dropDuplicates([key])
    return nodes.join(u, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def lookup(ids: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Every id with its node's columns, null where it does not exist: point lookups in bulk."""
    return ids.join(nodes, key, "left")


def to_json(nodes: DataFrame, without: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Nodes as JSON without their vectors, nulls kept out."""
    return nodes.select("*", F.to_json(F.struct(*[c for c in nodes.columns if c not in without])).alias("content"))
