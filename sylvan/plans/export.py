"""Markdown outlines and canvas layouts of finished trees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.session import cut


@dataclass(frozen=True)
class Sizes:
    """Of a canvas node, and the gaps between nodes."""

    width: int = 400
    height: int = 200
    gap_x: int = 50
    gap_y: int = 300


SIZES = Sizes()


def markdown_lines(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: a heading and an empty line for each summary, a bullet for each leaf;
    leaves that are missing are left out."""
    p = places.join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left").where("text is not null")
    body = T.trim(F.col("text"))
    bullet = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- **Chunk "), F.col("node_id"), F.lit("**: "), body)
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6))), F.lit(" "), body)
    lines = F.when(F.col("is_leaf"), F.array(bullet)).otherwise(F.array(heading, F.lit("")))
    rows = p.select("doc_id", "path", F.posexplode(lines).alias("k", "line"))
    at = Window.partitionBy("doc_id").orderBy("path", "k")
    return rows.select("doc_id", (F.row_number().over(at) - 1).alias("line_no"), "line")


def markdown(lines: DataFrame) -> DataFrame:
    """``doc_id, markdown``: the whole outline of each document."""
    x = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return x.select("doc_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("markdown"))


def widths(places: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """``places`` with ``width``: of a leaf the node's, else the children's with gaps, at least the node's."""
    p = cut(places)
    deepest = p.agg(F.max("depth")).first()[0]
    if deepest is None:
        return p.withColumn("width", F.lit(sizes.width))
    done, below = [], None
    for d in range(deepest, -1, -1):
        here = p.where(F.col("depth") == d)
        if below is None:
            here = here.withColumn("width", F.lit(sizes.width))
        else:
            under = below.groupBy("doc_id", F.slice("path", 1, d).alias("path")).agg((F.sum("width") + sizes.gap_x * (F.count("*") - 1)).alias("w"))
            here = here.join(under, ["doc_id", "path"], "left").withColumn("width", F.greatest(F.lit(sizes.width), F.coalesce("w", F.lit(sizes.width)))).drop("w")
        here = here.select("doc_id", "path", "node_id", "is_leaf", "depth", F.col("width").cast("long").alias("width"))
        done.append(here)
        below = here
    return cut(reduce(DataFrame.unionByName, done))


def layout(wide: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """``widths`` with ``x, y``: the root at the origin, children centred below; halves are cut towards zero."""
    deepest = wide.agg(F.max("depth")).first()[0]
    cur = wide.where("depth = 0").withColumn("cx", F.lit(0).cast("long"))
    done = [cur]
    for d in range(1, (deepest or 0) + 1):
        here = wide.where(F.col("depth") == d).withColumn("up", F.slice("path", 1, d - 1))
        family = Window.partitionBy("doc_id", "up")
        left = family.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("off", F.coalesce(F.sum(F.col("width") + sizes.gap_x).over(left), F.lit(0)))
        here = here.withColumn("block", F.sum("width").over(family) + sizes.gap_x * (F.count("*").over(family) - 1))
        above = cur.select("doc_id", F.col("path").alias("up"), F.col("cx").alias("pcx"))
        cx = (F.col("pcx") - F.col("block") / 2 + F.col("off") + F.col("width") / 2).cast("long")
        cur = here.join(above, ["doc_id", "up"]).select("doc_id", "path", "node_id", "is_leaf", "depth", "width", cx.alias("cx"))
        done.append(cur)
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "path", "node_id", "is_leaf", "depth", "width", (F.col("cx") - sizes.width // 2).cast("int").alias("x"), (F.col("depth") * (sizes.height + sizes.gap_y)).alias("y")
    )


def canvas_edges(places: DataFrame) -> DataFrame:
    """``doc_id, edge_no, id, from_node, to_node``: an edge follows the child's whole subtree."""
    name = T.display_id(F.col("node_id"), F.col("is_leaf"))
    child = places.where("depth > 0").select("doc_id", "path", F.slice("path", 1, F.greatest(F.col("depth") - 1, F.lit(0))).alias("up"), name.alias("to_node"))
    parent = places.select("doc_id", F.col("path").alias("up"), name.alias("from_node"))
    e = child.join(parent, ["doc_id", "up"])
    at = Window.partitionBy("doc_id").orderBy(F.array_append("path", F.lit(2147483647)))
    return e.select("doc_id", (F.row_number().over(at) - 1).alias("edge_no"), F.concat(F.lit("edge_"), "from_node", F.lit("_"), "to_node").alias("id"), "from_node", "to_node")


def canvas_nodes(placed: DataFrame, nodes: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """``doc_id, node_no, id, x, y, width, height, type, text`` in pre-order; missing texts are named so."""
    p = placed.join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left")
    text = F.when(F.col("is_leaf"), F.concat(F.lit("Chunk "), "node_id", F.lit("\n\n"), F.coalesce("text", F.lit("Missing Chunk")))).otherwise(F.coalesce("text", F.lit("Missing Node")))
    at = Window.partitionBy("doc_id").orderBy("path")
    return p.select(
        "doc_id", (F.row_number().over(at) - 1).alias("node_no"), T.display_id(F.col("node_id"), F.col("is_leaf")).alias("id"), "x", "y",
        F.lit(sizes.width).alias("width"), F.lit(sizes.height).alias("height"), F.lit("text").alias("type"), text.alias("text"),
    )


def canvas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, canvas``: the canvas file of each document as JSON."""
    n = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_no", F.struct("id", "x", "y", "width", "height", "type", "text").alias("v")))).alias("n"))
    e = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("edge_no", F.struct("id", F.col("from_node").alias("fromNode"), F.col("to_node").alias("toNode")).alias("v")))).alias("e"))
    none = F.array().cast("array<struct<id:string,fromNode:string,toNode:string>>")
    both = n.join(e, "doc_id", "left")
    file = F.struct(F.transform("n", lambda s: s["v"]).alias("nodes"), F.coalesce(F.transform("e", lambda s: s["v"]), none).alias("edges"))
    return both.select("doc_id", F.to_json(file, {"pretty": "true"}).alias("canvas"))
