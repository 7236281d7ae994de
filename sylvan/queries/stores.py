"""Upserts, lookups and checks on the node store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators import store, tree
from sylvan.queries.registry import query
from sylvan.session import table


@query(
    "upsert_nodes",
    """SELECT id, node_no, doc_id, level, md5(coalesce(text, '')) AS text_md5, epoch_us(ingested_at) AS ingested_us FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, node_no DESC) AS r FROM summary_nodes) WHERE r = 1""",
)
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "summary_nodes")
    late = F.col("ingested_at") > F.col("created_at") + F.expr("interval 1 day")
    out = store.upsert(s.where(~F.coalesce(late, F.lit(False))), s.where(late), ["id"], ["ingested_at", "node_no"])
    return out.select("id", "node_no", "doc_id", "level", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.unix_micros("ingested_at").alias("ingested_us"))


@query(
    "embedding_update",
    """WITH n AS (SELECT node_no, any_value(text) AS text FROM chunks GROUP BY 1), u AS (SELECT node_no, max(len(embedding)) AS dims FROM chunks WHERE embedding IS NOT NULL GROUP BY 1)
  SELECT node_no, coalesce(u.dims, -1)::INTEGER AS dims FROM n LEFT JOIN u USING (node_no)""",
)
def embedding_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    bare = c.dropDuplicates(["node_no"]).select("node_no", F.lit(None).cast("array<float>").alias("embedding"))
    return store.update_embeddings(bare, c.select("node_no", "embedding"), "node_no").select("node_no", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


@query(
    "node_lookup",
    """WITH v AS (SELECT DISTINCT node_id FROM verifications), s AS (SELECT id, min(node_no) AS node_no, min(level) AS level FROM summary_nodes GROUP BY 1)
  SELECT v.node_id, s.node_no, s.level FROM v LEFT JOIN s ON s.id = v.node_id""",
)
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "summary_nodes").groupBy(F.col("id").alias("node_id")).agg(F.min("node_no").alias("node_no"), F.min("level").alias("level"))
    return store.lookup(table(spark, d, "verifications").select("node_id").distinct(), s, "node_id")


@query("node_types", "SELECT 'chunk' AS type, count(DISTINCT node_no)::BIGINT AS nodes FROM chunks UNION ALL SELECT 'summary', count(DISTINCT node_no) FROM summary_nodes")
def node_types(spark: SparkSession, d: str) -> DataFrame:
    one = [table(spark, d, t).select(F.lit(n).alias("type"), "node_no") for t, n in (("chunks", "chunk"), ("summary_nodes", "summary"))]
    return one[0].union(one[1]).groupBy("type").agg(F.countDistinct("node_no").alias("nodes"))


@query("node_json")
def node_json(spark: SparkSession, d: str) -> DataFrame:
    return store.to_json(table(spark, d, "summary_nodes").select("node_no", "id", "doc_id", "level", "text", "children_indices", "embedding")).select("node_no", "content").distinct()


CHILDREN = "SELECT DISTINCT id, unnest(children_indices) AS child FROM summary_nodes"


@query(
    "orphans",
    f"WITH c AS ({CHILDREN}) SELECT id, child FROM c WHERE child IS NOT NULL AND NOT regexp_full_match(child, '[0-9]{{1,6}}') AND child NOT IN (SELECT id FROM summary_nodes WHERE id IS NOT NULL)",
)
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return tree.orphans(table(spark, d, "summary_nodes"))


@query(
    "unreferenced_chunks",
    f"""WITH c AS (SELECT DISTINCT s.doc_id, unnest(s.children_indices) AS child FROM summary_nodes s),
  k AS (SELECT DISTINCT doc_id, chunk_index FROM chunks)
  SELECT k.doc_id, k.chunk_index FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.child = k.chunk_index::VARCHAR)""",
)
def unreferenced_chunks(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "summary_nodes").select("doc_id", F.explode("children_indices").alias("child")).distinct()
    k = table(spark, d, "chunks").select("doc_id", "chunk_index").distinct().withColumn("child", F.col("chunk_index").cast("string"))
    return k.join(used, ["doc_id", "child"], "left_anti").select("doc_id", "chunk_index")


@query(
    "leaf_fanout",
    """WITH c AS (SELECT DISTINCT doc_id, id, unnest(children_indices) AS child FROM summary_nodes)
  SELECT doc_id, child, count(DISTINCT id)::BIGINT AS parents FROM c WHERE regexp_full_match(child, '[0-9]{1,6}') GROUP BY 1, 2""",
)
def leaf_fanout(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "summary_nodes").select("doc_id", "id", F.explode("children_indices").alias("child")).where("child rlike '^[0-9]{1,6}$'").distinct()
    return c.groupBy("doc_id", "child").agg(F.countDistinct("id").alias("parents"))


@query("level_counts", "SELECT level, count(DISTINCT id)::BIGINT AS nodes, count(DISTINCT doc_id)::BIGINT AS documents FROM summary_nodes GROUP BY 1")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summary_nodes").groupBy("level").agg(F.countDistinct("id").alias("nodes"), F.countDistinct("doc_id").alias("documents"))


MEMBER_SQL = """m AS (SELECT DISTINCT doc_id, level, cluster_id, unnest(node_indices) AS node FROM clusters),
  t AS (SELECT DISTINCT doc_id, chunk_index::VARCHAR AS node, text FROM chunks WHERE node_no IN (SELECT min(node_no) FROM chunks GROUP BY doc_id, chunk_index)
        UNION ALL SELECT DISTINCT doc_id, id, text FROM summary_nodes WHERE node_no IN (SELECT min(node_no) FROM summary_nodes GROUP BY doc_id, id)),
  j AS (SELECT m.*, t.text FROM m JOIN t USING (doc_id, node))"""


@query(
    "cluster_concat",
    f"""WITH {MEMBER_SQL} SELECT doc_id, level, cluster_id, count(*)::BIGINT AS members, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY length(node), node)) AS context_md5 FROM j GROUP BY 1, 2, 3""",
)
def cluster_concat(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the members of each stored cluster, in member order, joined by an empty line."""
    m = table(spark, d, "clusters").select("doc_id", "level", "cluster_id", F.explode("node_indices").alias("node")).distinct()
    c = store.last_version(table(spark, d, "chunks"), ["doc_id", "chunk_index"], [F.col("node_no")]).select("doc_id", F.col("chunk_index").cast("string").alias("node"), "text")
    s = store.last_version(table(spark, d, "summary_nodes"), ["doc_id", "id"], [F.col("node_no")]).select("doc_id", F.col("id").alias("node"), "text")
    j = m.join(c.union(s), ["doc_id", "node"])
    g = j.groupBy("doc_id", "level", "cluster_id").agg(F.sort_array(F.collect_list(F.struct(F.length("node").alias("n"), "node", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: v["text"]), "\n\n")
    return g.select("doc_id", "level", "cluster_id", F.size("x").cast("long").alias("members"), F.md5(text).alias("context_md5"))


@query(
    "node_json_fields",
    """SELECT DISTINCT node_no, id, doc_id, level::INTEGER AS level, md5(text) AS text_md5, len(children_indices)::INTEGER AS children, children_indices[1] AS first_child FROM summary_nodes""",
)
def node_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each node written as JSON and read back; the vector is not in it."""
    j = store.to_json(table(spark, d, "summary_nodes").select("node_no", "id", "doc_id", "level", "text", "children_indices", "embedding")).select("content")
    v = F.from_json("content", "node_no long, id string, doc_id long, level int, text string, children_indices array<string>, embedding array<float>")
    x = j.select(v.alias("v"), F.get_json_object("content", "$.embedding").alias("vector")).where("vector is null").select("v.*")
    children = F.when(F.col("children_indices").isNotNull(), F.size("children_indices"))
    return x.select("node_no", "id", "doc_id", "level", F.md5("text").alias("text_md5"), children.alias("children"), F.get("children_indices", F.lit(0)).alias("first_child")).distinct()
