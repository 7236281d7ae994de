"""Distances, thresholds, assignments and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import vectors as V
from sylvan.operators import chunking as C
from sylvan.operators import clustering as K
from sylvan.queries.registry import query
from sylvan.queries.sentences import fold_sql
from sylvan.session import table

# distinct chunk rows in reading order; NaN-safe equality is not needed, as node_no is unique
ORDERED_SQL = """one AS (SELECT node_no, any_value(doc_id) AS doc_id, any_value(chunk_index) AS chunk_index, any_value(text) AS text, any_value(embedding::DOUBLE[]) AS e FROM chunks GROUP BY 1),
ordered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, node_no) - 1)::INTEGER AS pos FROM one),
before AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM ordered),
fit AS (SELECT *, p IS NOT NULL AND e IS NOT NULL AND len(p) = len(e) AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(p, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM before),
norms AS (SELECT *, CASE WHEN ok THEN sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(p, p)) END AS n FROM fit),
dist AS (SELECT doc_id, pos, node_no, text,
  CASE WHEN ok THEN 1.0 - CASE WHEN n = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, list_inner_product(p, e) / n)) END END AS distance FROM norms)"""


def ordered_chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    one = table(spark, d, "chunks").select("node_no", "doc_id", "chunk_index", "text", "embedding").dropDuplicates(["node_no"])
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "node_no")) - 1
    return one.withColumn("pos", pos.cast("int"))


@query("adjacent_distance", f"WITH {ORDERED_SQL} SELECT node_no, doc_id, pos, round(distance, 6) AS distance FROM dist")
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacent_distances(ordered_chunks(spark, d)).select("node_no", "doc_id", "pos", F.round("distance", 6).alias("distance"))


@query("semantic_threshold", f"WITH {ORDERED_SQL} SELECT doc_id, round(quantile_cont(distance, 0.9), 6) AS threshold, count(*)::BIGINT AS gaps FROM dist WHERE distance IS NOT NULL GROUP BY 1")
def semantic_threshold(spark: SparkSession, d: str) -> DataFrame:
    return C.thresholds(C.adjacent_distances(ordered_chunks(spark, d)), 90).select("doc_id", F.round("threshold", 6).alias("threshold"), "gaps")


@query(
    "semantic_chunks",
    f"""WITH RECURSIVE {ORDERED_SQL},
thr AS (SELECT doc_id, quantile_cont(distance, 0.9) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY 1),
gaps AS (SELECT d.doc_id, d.pos, coalesce(length(d.text), 0) AS n, d.text, coalesce(d.distance > t.threshold, false) AS b FROM dist d LEFT JOIN thr t USING (doc_id)),
{fold_sql("gaps", 500, "s.b")},
chunked AS (SELECT f.doc_id, f.gid::INTEGER AS index, coalesce(string_agg(g.text, '' ORDER BY f.pos), '') AS text FROM f JOIN gaps g USING (doc_id, pos) GROUP BY 1, 2)
SELECT doc_id, index, md5(text) AS text_md5, length(text)::INTEGER AS chars,
  (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY index) - length(text))::INTEGER AS start_char_idx FROM chunked""",
)
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered_chunks(spark, d).select("doc_id", "pos", F.col("text").alias("sentence"), "embedding")
    c = C.semantic_chunks(rows, 90, 500)
    return c.select("doc_id", "index", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "start_char_idx")


@query(
    "embedding_validation",
    """WITH v AS (SELECT doc_id, embedding AS e FROM chunks)
  SELECT doc_id, count(*)::BIGINT AS vectors, count(*) FILTER (e IS NULL)::BIGINT AS missing,
    count(*) FILTER (e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0)::BIGINT AS not_finite,
    min(len(e))::INTEGER AS dim_min, max(len(e))::INTEGER AS dim_max,
    coalesce(count(*) FILTER (e IS NULL) = 0 AND count(*) FILTER (e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0) = 0 AND min(len(e)) > 0 AND min(len(e)) = max(len(e)), false) AS usable
  FROM v GROUP BY 1""",
)
def embedding_validation(spark: SparkSession, d: str) -> DataFrame:
    return K.check_vectors(table(spark, d, "chunks"))


@query("vector_norms", "SELECT vec_id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::INTEGER AS dims FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dims"))


@query("hard_clusters", "SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members, count(*)::BIGINT AS size FROM embeddings GROUP BY 1")
def hard_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = K.hard_groups(table(spark, d, "embeddings"), [], "label", "vec_id")
    return g.select("label", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "size")


SOFT_SQL = """cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
ranked AS (SELECT label, c, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS k FROM cent),
d AS (SELECT e.vec_id, r.k, round(sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], r.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS dist FROM embeddings e, ranked r),
w AS (SELECT vec_id, k, exp(-(dist - min(dist) OVER (PARTITION BY vec_id)) / 0.2) AS w FROM d),
p AS (SELECT vec_id, k, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w)"""


#: Most labels whose means are fetched to score every vector against.
MOST_LABELS = 1_000


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, p``: for each vector the softmax of its distances to the label means. The means are
    a fixed small set (checked) and travel with the plan; vectors are only grouped by their own id."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cent = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    means = cent.orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(means) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, r["c"])).alias("c")) for k, r in enumerate(means)]))
    rows = e.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), each.alias("m"))
    gap = F.zip_with("e", "m.c", lambda a, b: (a - b) * (a - b))
    near = rows.select("vec_id", "m.k", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, x: t + x)), 9).alias("dist"))
    least = near.groupBy("vec_id").agg(F.min("dist").alias("least"), F.collect_list(F.struct("k", "dist")).alias("x"))
    w = least.select("vec_id", F.explode(F.transform("x", lambda s: F.struct(s["k"].alias("k"), F.exp(-(s["dist"] - F.col("least")) / 0.2).alias("w")))).alias("y"))
    total = w.groupBy("vec_id").agg(F.sum("y.w").alias("total"), F.sort_array(F.collect_list("y")).alias("y"))
    return total.select("vec_id", F.transform("y", lambda s: F.round(s["w"] / F.col("total"), 6)).alias("p"))


@query(
    "soft_assign",
    f"""WITH {SOFT_SQL}, best AS (SELECT vec_id, arg_max(k, (p, -k)) AS k FROM p GROUP BY 1)
  SELECT p.vec_id, p.k AS cluster_id, p.p AS probability FROM p JOIN best b USING (vec_id)
  WHERE p.p >= 0.1 OR (p.k = b.k AND (SELECT max(q.p) FROM p q WHERE q.vec_id = p.vec_id) < 0.1)""",
)
def soft_assign(spark: SparkSession, d: str) -> DataFrame:
    return K.soft_membership(probabilities(spark, d), [], "vec_id", "p", 0.1).select("vec_id", "cluster_id", "probability")


@query(
    "small_cluster",
    """SELECT doc_id, count(DISTINCT node_no)::BIGINT AS nodes, CASE WHEN count(DISTINCT node_no) = 0 THEN 'none' WHEN count(DISTINCT node_no) <= 5 THEN 'single'
    WHEN count(DISTINCT node_no) > 20000 THEN 'approximate' ELSE 'mixture' END AS route FROM chunks GROUP BY 1""",
)
def small_cluster(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "chunks").groupBy("doc_id").agg(F.countDistinct("node_no").alias("nodes"))
    return n.withColumn("route", K.route(F.col("nodes")))


SCORES = [("a", 2, 10.0), ("a", 3, 7.5), ("a", 4, 7.5), ("b", 2, 1.0), ("b", 3, 2.0), ("c", 5, -3.0)]


@query("best_k", "SELECT name, arg_min(k, (bic, k))::INTEGER AS k FROM (VALUES " + ", ".join(f"('{a}', {k}, {b})" for a, k, b in SCORES) + ") t(name, k, bic) GROUP BY 1")
def best_k(spark: SparkSession, d: str) -> DataFrame:
    return K.best_k(spark.createDataFrame(SCORES, "name string, k int, bic double"), ["name"])


@query(
    "forced_reduction",
    """WITH m AS (SELECT DISTINCT doc_id, level, cluster_id, unnest(node_indices) AS node FROM clusters),
  c AS (SELECT doc_id, level, count(DISTINCT cluster_id) AS k, count(DISTINCT node) AS n FROM m GROUP BY 1, 2)
  SELECT m.doc_id, m.level, m.node, CASE WHEN c.k = c.n AND c.n > 1 AND c.n < 20 THEN 0 ELSE m.cluster_id END::INTEGER AS cluster_id, (c.k = c.n AND c.n >= 20) AS stuck
  FROM m JOIN c USING (doc_id, level)""",
)
def forced_reduction(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "clusters").select("doc_id", "level", "cluster_id", F.explode("node_indices").alias("node")).distinct()
    n = m.groupBy("doc_id", "level").agg(F.countDistinct("node").alias("n"))
    return K.forced(m, n, ["doc_id", "level"]).select("doc_id", "level", "node", "cluster_id", "stuck")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each label as the nodes of one document, in order."""
    e = table(spark, d, "embeddings")
    from pyspark.sql import Window

    return e.select(F.col("label").cast("long").alias("doc_id"), "vec_id", "embedding").withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("vec_id")) - 1).cast("int")).select("doc_id", "ord", "embedding")


@query("gmm_bic")
def gmm_bic(spark: SparkSession, d: str) -> DataFrame:
    p = K.mixture(_groups(spark, d))
    return K.soft_membership(p, ["doc_id"], "ord", "probabilities").select("doc_id", "ord", "cluster_id", F.round("probability", 4).alias("probability"))


@query("pca_kmeans")
def pca_kmeans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.lit(0).cast("long").alias("doc_id"), F.col("vec_id").cast("int").alias("ord"), "embedding")
    return K.pca_kmeans(e).select("ord", "label")
