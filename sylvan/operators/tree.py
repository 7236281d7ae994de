"""Levels of summaries up to one root for each document, all documents at once.

A level is one aggregation by document and cluster and one small one by document, over the
documents that still have more than one node; its result is written once, so a level never
recomputes those below it. No step gathers a whole document: a document that holds a third of all
nodes is spread over its clusters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.operators.clustering import FORCE_BELOW, by_order
from sylvan.session import cut

#: Takes nodes of one level, gives them back with ``cluster_id``, a node once for each of its clusters.
Clusterer = Callable[[DataFrame], DataFrame]


def summary_id(doc: Column, level: int, cluster: Column) -> Column:
    """A node id that is the same on every retry."""
    return F.sha2(F.concat_ws("/", doc, F.lit(level), cluster), 256)


def build(leaves: DataFrame, cluster: Clusterer | None = None, summarize: Callable[[Column], Column] = T.mock_summary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and trees of ``doc_id, ord, node_id, text`` (``ord`` from 0 without gaps).

    A document of one leaf gets a root of level 1 with the leaf's text. A level that clustering
    does not shrink is merged whole below 20 nodes; from 20 on the document stops with status
    'unreduced' and its first node as root. Documents without leaves have no tree. A cluster's
    texts are joined in member order by empty lines; a null text counts as empty.
    """
    cluster = cluster or by_order()
    sizes = leaves.groupBy("doc_id").agg(F.count("*").alias("n"))
    base = leaves.join(sizes, "doc_id").select(
        "doc_id", F.lit(0).alias("level"), F.col("ord").cast("int").alias("ord"), "node_id", F.lit(True).alias("is_leaf"), "text", F.lit(None).cast("int").alias("cluster_id"), "n",
        F.array().cast("array<struct<child_id:string,child_is_leaf:boolean>>").alias("kids"),
    )
    cur = cut(base)
    levels, stopped = [cur], []
    level = 0
    # a document goes on only while its level has fewer nodes than the one below, so the levels end
    while level == 0 or not cur.where("n > 1").isEmpty():
        level += 1
        members = cluster(cur.where("n > 1").select("doc_id", "ord", "node_id", "is_leaf", "text", "n"))
        one = F.struct("ord", "node_id", "is_leaf", F.coalesce("text", F.lit("")).alias("text"))
        groups = cut(members.groupBy("doc_id", "cluster_id").agg(F.sort_array(F.collect_list(one)).alias("x"), F.first("n").alias("n")))
        per_doc = groups.groupBy("doc_id").agg(F.count("*").alias("k"), F.max("cluster_id").alias("last"))
        g = groups.join(per_doc, "doc_id").withColumn("same", F.col("k") >= F.col("n"))
        stopped.append(g.where(F.col("same") & (F.col("n") >= FORCE_BELOW)).select("doc_id").distinct())
        # cluster ids without gaps are the order; only where some are missing are they counted
        dense = F.col("last") + 1 == F.col("k")
        nth = F.row_number().over(Window.partitionBy("doc_id", F.when(dense, F.col("cluster_id"))).orderBy("cluster_id")) - 1
        grown = g.where("not same").withColumn("at", F.when(dense, F.col("cluster_id")).otherwise(nth)).select("doc_id", F.col("at").cast("int").alias("at"), "cluster_id", "x", F.col("k").alias("n"))
        merged = g.where(F.col("same") & (F.col("n") < FORCE_BELOW)).groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
        new = grown.union(merged.select("doc_id", F.lit(0), F.lit(0), "x", F.lit(1).cast("long")))
        context = F.array_join(F.transform("x", lambda s: s["text"]), "\n\n")
        kids = F.transform("x", lambda s: F.struct(s["node_id"].alias("child_id"), s["is_leaf"].alias("child_is_leaf")))
        rows = new.select(
            "doc_id", F.lit(level).alias("level"), F.col("at").alias("ord"), summary_id(F.col("doc_id"), level, F.col("cluster_id")).alias("node_id"), F.lit(False).alias("is_leaf"),
            summarize(context).alias("text"), "cluster_id", "n", kids.alias("kids"),
        )
        if level == 1:
            alone = F.array(F.struct(F.col("node_id").alias("child_id"), F.lit(True).alias("child_is_leaf")))
            rows = rows.union(cur.where("n = 1").select("doc_id", F.lit(1), F.lit(0), summary_id(F.col("doc_id"), 1, F.lit(0)), F.lit(False), "text", F.lit(0), "n", alone))
        cur = cut(rows)
        levels.append(cur)
    every = reduce(DataFrame.unionByName, levels)
    edges = every.select("doc_id", F.col("node_id").alias("parent_id"), F.posexplode("kids").alias("ord", "kid")).select("doc_id", "parent_id", "kid.child_id", "kid.child_is_leaf", "ord")
    stuck = reduce(DataFrame.union, stopped).distinct().withColumn("stuck", F.lit(True))
    top = every.groupBy("doc_id").agg(F.max("level").alias("levels"))
    root = every.where("ord = 0").join(top, "doc_id").where("level = levels").join(stuck, "doc_id", "left")
    status = F.when(F.coalesce("stuck", F.lit(False)), "unreduced").otherwise("complete")
    return every.drop("n", "kids"), edges, root.select("doc_id", F.col("node_id").alias("root_id"), "levels", status.alias("status"))


def occurrences(nodes: DataFrame, edges: DataFrame, trees: DataFrame) -> DataFrame:
    """``doc_id, path, node_id, is_leaf, depth``: every place of a node below its root in pre-order of
    ``path`` (child positions from the root). A node with several parents has several places."""
    flag = nodes.select("doc_id", "node_id", "is_leaf").distinct()
    cur = trees.join(flag.withColumnRenamed("node_id", "root_id"), ["doc_id", "root_id"]).select("doc_id", F.array().cast("array<int>").alias("path"), F.col("root_id").alias("node_id"), "is_leaf")
    depth = trees.agg(F.max("levels")).first()[0] or 0
    places = [cur]
    for _ in range(depth):
        inner = cur.where("not is_leaf").select("doc_id", "path", F.col("node_id").alias("parent_id"))
        down = inner.join(edges, ["doc_id", "parent_id"])
        cur = cut(down.select("doc_id", F.array_append("path", F.col("ord")).alias("path"), F.col("child_id").alias("node_id"), F.col("child_is_leaf").alias("is_leaf")))
        places.append(cur)
    return reduce(DataFrame.union, places).withColumn("depth", F.size("path"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Links of ``summary_nodes`` to ids that do not exist."""
    children = nodes.where("id is not null").select("id", F.explode("children_indices").alias("child")).where("child is not null and not child rlike '^[0-9]{1,6}$'").distinct()
    return children.join(nodes.select(F.col("id").alias("child")).distinct(), "child", "left_anti").select("id", "child")
