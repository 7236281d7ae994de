"""Trees of summaries over the stored chunks, grouped deterministically so that SQL can replay them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.operators import tree
from sylvan.plans import verify
from sylvan.queries.registry import query
from sylvan.queries.sentences import mock_sql, strip_sql
from sylvan.session import cut, once, table

#: Levels that the SQL unrolls: five to the sixth leaves of one document.
LEVELS = 6
LEAVES_SQL = f"""leaf AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, node_no) - 1)::INTEGER AS ord, node_no::VARCHAR AS node_id, text
    FROM (SELECT DISTINCT node_no, doc_id, chunk_index, text FROM chunks) WHERE text IS NOT NULL AND length({strip_sql("text")}) > 0)"""


def tree_sql(leaves: str = LEAVES_SQL, clean: str = "{}") -> str:
    """The trees over ``leaves``; ``clean`` is what a context goes through before it is summarized."""
    out = [leaves, "l0 AS (SELECT doc_id, 0 AS level, ord, node_id, text, 0 AS cluster_id FROM leaf)"]
    for k in range(1, LEVELS + 1):
        text = mock_sql(clean.format("context"))
        body = f"CASE WHEN n = 1 THEN context ELSE {text} END" if k == 1 else text
        most = "" if k == 1 else "WHERE n > 1"
        out.append(
            f"""l{k} AS (SELECT doc_id, {k} AS level, cluster_id::INTEGER AS ord, sha256(doc_id::VARCHAR || '/{k}/' || cluster_id::VARCHAR) AS node_id, {body} AS text, cluster_id
    FROM (SELECT doc_id, (ord // 5)::INTEGER AS cluster_id, any_value(n) AS n, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS context
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l{k - 1}) {most} GROUP BY 1, 2))"""
        )
    every = " UNION ALL ".join(f"SELECT doc_id, level, ord, node_id, text FROM l{k}" for k in range(LEVELS + 1))
    return (
        ", ".join(out)
        + f""", nodes AS ({every}),
  tops AS (SELECT doc_id, max(level) AS levels FROM nodes GROUP BY 1),
  edges AS (SELECT p.doc_id, p.node_id AS parent_id, c.node_id AS child_id, c.level = 0 AS child_is_leaf, (c.ord % 5)::INTEGER AS ord
    FROM nodes p JOIN nodes c ON c.doc_id = p.doc_id AND c.level = p.level - 1 AND c.ord // 5 = p.ord)"""
    )


def leaves(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("node_no", "doc_id", "chunk_index", "text").distinct().where(F.length(T.trim(F.col("text"))) > 0)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "node_no")) - 1
    return c.select("doc_id", at.cast("int").alias("ord"), F.col("node_no").cast("string").alias("node_id"), "text")


def built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and trees over the chunks of ``d``, built once for each session and state of the
    files, stored, and read from there by every query."""

    def build() -> tuple[DataFrame, ...]:
        nodes, edges, trees = tree.build(leaves(spark, d))  # each level is written already
        return nodes, edges, cut(trees)

    return once(spark, f"{d}/chunks.parquet", "trees", build)


@query("tree_levels", f"WITH {tree_sql()} SELECT doc_id, level, ord, node_id, md5(text) AS text_md5 FROM nodes")
def tree_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, _ = built(spark, d)
    return nodes.select("doc_id", "level", "ord", "node_id", F.md5("text").alias("text_md5"))


@query("tree_edges", f"WITH {tree_sql()} SELECT * FROM edges")
def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d)[1].select("doc_id", "parent_id", "child_id", "child_is_leaf", F.col("ord").cast("int").alias("ord"))


@query("tree_roots", f"WITH {tree_sql()} SELECT t.doc_id, n.node_id AS root_id, t.levels::INTEGER AS levels, 'complete' AS status FROM tops t JOIN nodes n ON n.doc_id = t.doc_id AND n.level = t.levels AND n.ord = 0")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d)[2].select("doc_id", "root_id", F.col("levels").cast("int").alias("levels"), "status")


@query(
    "verify_pairs",
    f"""WITH {tree_sql()} SELECT t.doc_id, n.node_id AS root_id, n.text AS summary, md5((SELECT string_agg(c.text, chr(10) || chr(10) ORDER BY e.ord) FROM edges e JOIN nodes c ON c.doc_id = e.doc_id AND c.node_id = e.child_id
    WHERE e.doc_id = t.doc_id AND e.parent_id = n.node_id)) AS source_md5 FROM tops t JOIN nodes n ON n.doc_id = t.doc_id AND n.level = t.levels AND n.ord = 0""",
)
def verify_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = verify.pairs(*built(spark, d))
    return p.select("doc_id", "root_id", "summary", F.md5("source").alias("source_md5"))


@query(
    "root_sources",
    """WITH s AS (SELECT DISTINCT doc_id, id, children_indices FROM summary_nodes), k AS (SELECT DISTINCT id, unnest(children_indices) AS child FROM s),
  r AS (SELECT s.doc_id, s.id FROM s WHERE s.id NOT IN (SELECT child FROM k WHERE child IS NOT NULL)),
  t AS (SELECT id, text FROM summary_nodes WHERE node_no IN (SELECT min(node_no) FROM summary_nodes GROUP BY id) GROUP BY 1, 2),
  c AS (SELECT doc_id, chunk_index::VARCHAR AS child, arg_min(coalesce(text, ''), node_no) AS text FROM chunks GROUP BY 1, 2)
  SELECT r.doc_id, r.id AS root_id, count(coalesce(t.id, c.child))::BIGINT AS children, coalesce(sum(length(coalesce(t.text, c.text))), 0)::BIGINT AS chars
  FROM r LEFT JOIN k ON k.id = r.id LEFT JOIN t ON t.id = k.child LEFT JOIN c ON c.doc_id = r.doc_id AND c.child = k.child GROUP BY 1, 2""",
)
def root_sources(spark: SparkSession, d: str) -> DataFrame:
    """The stored roots and what there is to check them against: child nodes and child chunks."""
    s = table(spark, d, "summary_nodes").where("id is not null")
    k = s.select("id", F.explode("children_indices").alias("child")).distinct()
    roots = s.select("doc_id", "id").distinct().join(k.select(F.col("child").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    t = s.groupBy(F.col("id").alias("child")).agg(F.min_by("text", "node_no").alias("text")).withColumn("there", F.lit(1))
    chunk = table(spark, d, "chunks").groupBy("doc_id", F.col("chunk_index").cast("string").alias("child")).agg(F.min_by(F.coalesce("text", F.lit("")), "node_no").alias("leaf"))
    j = roots.join(k, "id", "left").join(t, "child", "left").join(chunk, ["doc_id", "child"], "left")
    j = j.withColumn("text", F.coalesce("text", "leaf")).withColumn("there", F.coalesce("there", F.when(F.col("leaf").isNotNull(), 1)))
    return j.groupBy("doc_id", F.col("id").alias("root_id")).agg(F.count("there").alias("children"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"))
