"""Markdown outlines and canvases of the deterministic trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators import tree
from sylvan.plans import export
from sylvan.queries.registry import query
from sylvan.queries.sentences import strip_sql
from sylvan.queries.trees import LEVELS, built, tree_sql
from sylvan.session import cut, once

PLACES_SQL = f"""{tree_sql()},
places AS (
  SELECT t.doc_id, []::INTEGER[] AS path, n.node_id, n.level = 0 AS is_leaf, n.text, 0 AS depth
  FROM tops t JOIN nodes n ON n.doc_id = t.doc_id AND n.level = t.levels AND n.ord = 0
  UNION ALL
  SELECT p.doc_id, list_append(p.path, e.ord), e.child_id, e.child_is_leaf, n.text, p.depth + 1
  FROM places p JOIN edges e ON e.doc_id = p.doc_id AND e.parent_id = p.node_id JOIN nodes n ON n.doc_id = e.doc_id AND n.node_id = e.child_id)"""
NAME_SQL = "CASE WHEN {0}is_leaf THEN 'chunk_' || {0}node_id ELSE {0}node_id END"


def width_sql() -> str:
    """Widths from the deepest level up."""
    out = [f"w{LEVELS} AS (SELECT doc_id, path, node_id, is_leaf, text, depth, 400::BIGINT AS width FROM places WHERE depth = {LEVELS})"]
    for k in range(LEVELS - 1, -1, -1):
        out.append(
            f"""w{k} AS (SELECT p.doc_id, p.path, p.node_id, p.is_leaf, p.text, p.depth, greatest(400, coalesce(u.w, 400))::BIGINT AS width FROM places p
  LEFT JOIN (SELECT doc_id, path[1:{k}] AS path, sum(width) + 50 * (count(*) - 1) AS w FROM w{k + 1} GROUP BY 1, 2) u ON u.doc_id = p.doc_id AND u.path = p.path WHERE p.depth = {k})"""
        )
    return ", ".join(out) + ", wide AS (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(LEVELS + 1)) + ")"


def layout_sql() -> str:
    """Centres from the root down; halves are cut towards zero."""
    out = ["c0 AS (SELECT doc_id, path, node_id, is_leaf, depth, width, 0::BIGINT AS cx FROM wide WHERE depth = 0)"]
    for k in range(1, LEVELS + 1):
        out.append(
            f"""c{k} AS (SELECT h.doc_id, h.path, h.node_id, h.is_leaf, h.depth, h.width, trunc(a.cx - h.block / 2.0 + h.off + h.width / 2.0)::BIGINT AS cx FROM (
    SELECT *, coalesce(sum(width + 50) OVER (PARTITION BY doc_id, path[1:{k - 1}] ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
      sum(width) OVER (PARTITION BY doc_id, path[1:{k - 1}]) + 50 * (count(*) OVER (PARTITION BY doc_id, path[1:{k - 1}]) - 1) AS block FROM wide WHERE depth = {k}) h
    JOIN c{k - 1} a ON a.doc_id = h.doc_id AND a.path = h.path[1:{k - 1}])"""
        )
    return ", ".join(out) + ", placed AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(LEVELS + 1)) + ")"


LINES_SQL = f"""WITH RECURSIVE {PLACES_SQL},
rows AS (SELECT doc_id, path, 0 AS k, CASE WHEN is_leaf THEN repeat('  ', depth) || '- **Chunk ' || node_id || '**: ' || {strip_sql("text")} ELSE repeat('#', least(depth + 1, 6)) || ' ' || {strip_sql("text")} END AS line FROM places
  UNION ALL SELECT doc_id, path, 1, '' FROM places WHERE NOT is_leaf),
lines AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY path, k) - 1)::INTEGER AS line_no, line FROM rows)"""


def places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, trees = built(spark, d)
    return once(spark, f"{d}/chunks.parquet", "places", lambda: cut(tree.occurrences(nodes, edges, trees))), nodes


@query("markdown_lines", f"{LINES_SQL} SELECT doc_id, line_no, md5(line) AS line_md5 FROM lines")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.markdown_lines(*places(spark, d)).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query("markdown_documents", f"{LINES_SQL} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS markdown_md5 FROM lines GROUP BY 1")
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    return export.markdown(export.markdown_lines(*places(spark, d))).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query("canvas_width", f"WITH RECURSIVE {PLACES_SQL}, {width_sql()} SELECT doc_id, array_to_string(path, '.') AS path, node_id, width FROM wide")
def canvas_width(spark: SparkSession, d: str) -> DataFrame:
    w = export.widths(places(spark, d)[0])
    return w.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "node_id", "width")


@query("canvas_layout", f"WITH RECURSIVE {PLACES_SQL}, {width_sql()}, {layout_sql()} SELECT doc_id, array_to_string(path, '.') AS path, {NAME_SQL.format('')} AS id, (cx - 200)::INTEGER AS x, (depth * 500)::INTEGER AS y FROM placed")
def canvas_layout(spark: SparkSession, d: str) -> DataFrame:
    from sylvan.functions.text import display_id

    p = export.layout(export.widths(places(spark, d)[0]))
    return p.select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), display_id(F.col("node_id"), F.col("is_leaf")).alias("id"), "x", F.col("y").cast("int").alias("y"))


@query(
    "canvas_edges",
    f"""WITH RECURSIVE {PLACES_SQL} SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY list_append(c.path, 2147483647)) - 1)::INTEGER AS edge_no,
  'edge_' || {NAME_SQL.format("p.")} || '_' || {NAME_SQL.format("c.")} AS id FROM places c JOIN places p ON p.doc_id = c.doc_id AND c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path""",
)
def canvas_edges(spark: SparkSession, d: str) -> DataFrame:
    return export.canvas_edges(places(spark, d)[0]).select("doc_id", "edge_no", "id")


@query("canvas_files")
def canvas_files(spark: SparkSession, d: str) -> DataFrame:
    p, nodes = places(spark, d)
    placed = export.layout(export.widths(p))
    return export.canvas(export.canvas_nodes(placed, nodes), export.canvas_edges(p))
