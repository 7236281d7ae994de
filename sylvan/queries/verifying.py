"""Verification of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.plans import verify
from sylvan.queries.registry import query
from sylvan.session import table

REPLIES = [
    ("plain", '{"score": 1.0, "details": [{"claim": "A", "verdict": "Supported", "reasoning": "in text"}], "unsupported_claims": []}'),
    ("fenced", '```json\n{"score": 0.5, "details": [{"claim": "B", "verdict": "Contradicted", "reasoning": "no"}], "unsupported_claims": ["B"], "model_name": "m1"}\n```'),
    ("two", '```\n{"score": 0.25, "details": [{"claim": "C", "verdict": "Unsupported", "reasoning": ""}, {"claim": "D", "verdict": "Supported", "reasoning": ""}], "unsupported_claims": ["C"]}\n```'),
    ("broken", "Sorry, I cannot do that."),
    ("empty", ""),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query(
    "verification_parse",
    rf"""WITH r(name, reply) AS (VALUES {_values(REPLIES)}), j AS (SELECT name, trim(regexp_replace(regexp_replace(reply, '^```(json)?\s*', '', 'i'), '\s*```$', '')) AS t FROM r),
  v AS (SELECT name, CASE WHEN json_valid(t) AND t <> '' THEN t::JSON END AS x FROM j)
  SELECT name, (x->>'$.score')::DOUBLE AS score, coalesce(json_array_length(x->'$.details'), -1)::INTEGER AS claims, (x->>'$.unsupported_claims[0]') AS first_unsupported,
    CASE WHEN x IS NOT NULL THEN coalesce(x->>'$.model_name', 'gpt-4o') END AS model_name FROM v""",
)
def verification_parse(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame(REPLIES, "name string, reply string").select("name", verify.parse(F.col("reply"), "gpt-4o").alias("v"))
    return r.select("name", "v.score", F.coalesce(F.size("v.details"), F.lit(-1)).alias("claims"), F.get("v.unsupported_claims", F.lit(0)).alias("first_unsupported"), "v.model_name")


@query(
    "mock_verification",
    """WITH n AS (SELECT DISTINCT node_no, text FROM summary_nodes)
  SELECT node_no, CASE WHEN text IS NULL OR length(text) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN text IS NULL OR length(text) = 0 THEN 'Skipped' ELSE 'Mock' END AS model_name,
    CASE WHEN text IS NULL OR length(text) = 0 THEN 'Empty Input' ELSE '' END AS unsupported FROM n""",
)
def mock_verification(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "summary_nodes").select("node_no", "text").distinct()
    v = n.select("node_no", verify.mock(F.col("text"), F.col("text")).alias("v"))
    return v.select("node_no", "v.score", "v.model_name", F.array_join("v.unsupported_claims", ",").alias("unsupported"))


@query(
    "verdicts",
    """WITH v AS (SELECT DISTINCT node_id, checked_at, details FROM verifications WHERE details IS NOT NULL)
  SELECT node_id, epoch_us(checked_at) AS checked_us, len(details)::INTEGER AS claims, len(list_filter(details, lambda x: lower(trim(coalesce(x.verdict, ''))) = 'supported'))::INTEGER AS supported,
    array_to_string(list_transform(list_filter(details, lambda x: lower(trim(coalesce(x.verdict, ''))) <> 'supported'), lambda x: coalesce(x.claim, '')), '|') AS unsupported FROM v""",
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verifications").where("details is not null").select("node_id", "checked_at", "details").distinct()
    bad = F.filter("details", lambda x: F.lower(F.trim(F.coalesce(x["verdict"], F.lit("")))) != "supported")
    good = F.size(F.filter(verify.supported(F.col("details")), lambda x: x))
    return v.select("node_id", F.unix_micros("checked_at").alias("checked_us"), F.size("details").alias("claims"), good.alias("supported"), F.array_join(F.transform(bad, lambda x: F.coalesce(x["claim"], F.lit(""))), "|").alias("unsupported"))


@query(
    "model_scores",
    """WITH v AS (SELECT DISTINCT node_id, model_name, score, checked_at FROM verifications)
  SELECT model_name, count(*)::BIGINT AS checks, count(score)::BIGINT AS scored, round(avg(score), 6) AS mean_score, min(score) AS least FROM v GROUP BY 1""",
)
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verifications").select("node_id", "model_name", "score", "checked_at").distinct()
    return v.groupBy("model_name").agg(F.count("*").alias("checks"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("least"))


MESSAGES = [("1", "Error: context_length_exceeded (8192)"), ("2", "Rate limit reached"), ("3", "rate_limit_error"), ("4", "socket closed"), ("5", None)]


@query(
    "error_category",
    f"""SELECT name, CASE WHEN message IS NULL THEN NULL WHEN lower(message) LIKE '%context_length_exceeded%' THEN 'context_length_exceeded'
    WHEN contains(lower(message), 'rate_limit') OR contains(lower(message), 'rate limit') THEN 'rate_limit' ELSE 'other' END AS category FROM (VALUES {_values(MESSAGES)}) t(name, message)""",
)
def error_category(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(MESSAGES, "name string, message string").select("name", T.error_category(F.col("message")).alias("category"))
