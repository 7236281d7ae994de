"""The named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import leakage, lookalike, pieces, prose, sentences, similarity, tokens, truncation
from sylvan.queries.sentences import strip_sql
from sylvan.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _records(spark: SparkSession, d: str) -> DataFrame:
    return similarity.records(table(spark, d, "chunks"), table(spark, d, "summary_nodes"))


#: Every pair by the exact cosine; as clusters do not touch, a record's first is the smallest similar to it.
_COSINE_SQL = """WITH n AS (SELECT node_no, embedding FROM chunks UNION ALL SELECT node_no, embedding FROM summary_nodes),
u AS (SELECT node_no, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM n WHERE node_no IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""


@query("p2_found", f"{_COSINE_SQL} SELECT min(a.node_no) AS first_no, b.node_no FROM u a JOIN u b ON a.node_no < b.node_no AND list_cosine_similarity(a.v, b.v) >= 0.9 GROUP BY b.node_no")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similarity.found(_records(spark, d))


@query("p2_clusters")
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.describe(_records(spark, d))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


@query("p7_counts")
def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_items")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return pieces.items(table(spark, d, "input_docs"), table(spark, d, "chunks"))


@query(
    "p5_found",
    f"""WITH i AS (SELECT 'document' AS item_kind, doc_id AS item_id, content AS text FROM input_docs UNION ALL SELECT 'chunk', node_no, text FROM chunks)
  SELECT DISTINCT i.item_kind, i.item_id FROM i JOIN split_limits l USING (item_kind) WHERE i.item_id IS NOT NULL AND length({strip_sql("i.text")}) > l.max_chars""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(_items(spark, d), table(spark, d, "split_limits"))


@query("p5_pieces")
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_items(spark, d), table(spark, d, "split_limits")).dropDuplicates(["item_kind", "item_id", "piece_no"])


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(table(spark, d, "chunks"))


@query("p6_chunks")
def p6_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.texts(table(spark, d, "chunks").dropDuplicates(["node_no"]), ["node_no"], "text")


@query("p6_documents")
def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.texts(table(spark, d, "input_docs").dropDuplicates(["doc_id"]), ["doc_id"], "content")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # rows delivered twice give the same positions, and positions are far smaller to shuffle than texts
    return sentences.split(table(spark, d, "input_docs"), "doc_id", "content", with_text=False).select("doc_id", "start_idx", "end_idx").distinct()


@query("p3_sentences")
def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "input_docs").select("doc_id", "content").distinct()
    return sentences.split(docs, "doc_id", "content")


@query("p3_chunks")
def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("node_no", "text").distinct()
    return sentences.split(chunks, "node_no", "text")


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "summary_nodes"))


@query("p4_sources")
def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "summary_nodes"))


@query("p4_limits")
def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(table(spark, d, "summary_nodes"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.found(table(spark, d, "documents"), table(spark, d, "common_words"))


@query("p9_statistics")
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
