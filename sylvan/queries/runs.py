"""Whole runs through files, stores, streams and models, each read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.config import PipelineConfig
from sylvan.functions import providers
from sylvan.functions import text as T
from sylvan.operators import clustering
from sylvan.plans import export, pipeline, verify
from sylvan.queries.exports import NAME_SQL, PLACES_SQL, layout_sql, places, width_sql
from sylvan.queries.registry import query
from sylvan.queries.sentences import CHUNKS_NORMALIZED, DOCS, docs
from sylvan.queries.trees import built, tree_sql
from sylvan.session import scratch, table
from sylvan.sources import text as sources
from sylvan.sources.node_store import NodeStore
from sylvan.streaming import documents


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("file_source", f"WITH {DOCS} SELECT doc_id, (length(content) + 1)::INTEGER AS chars, md5(content || chr(10)) AS content_md5 FROM docs")
def file_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as text files, each ended by a line feed, and read whole."""
    folder = _folder(spark, "files")
    docs(spark, d).where("content is not null").select("doc_id", "content").write.partitionBy("doc_id").text(folder)
    found = sources.files(spark, folder)
    return found.select(F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


@query("stored_nodes", f"WITH {tree_sql()} SELECT doc_id, level, ord, node_id, level = 0 AS is_leaf, md5(text) AS text_md5 FROM nodes")
def stored_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes kept in a store on disk; half of the documents are written again, which replaces them."""
    store = NodeStore(spark, _folder(spark, "store"))
    nodes = built(spark, d)[0]
    store.write("nodes", nodes)
    store.write("nodes", nodes.where("doc_id % 2 = 0"))
    return store.read("nodes").select("doc_id", "level", "ord", "node_id", "is_leaf", F.md5("text").alias("text_md5"))


@query("streamed_chunks", f"WITH RECURSIVE {CHUNKS_NORMALIZED} SELECT doc_id, index, md5(text) AS text_md5 FROM nchunked")
def streamed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive as files, chunked by a stream that runs until none is left."""
    folder = _folder(spark, "stream")
    docs(spark, d).select("doc_id", "content").repartition(3).write.parquet(f"{folder}/in")
    stream = documents.write_chunks(documents.read(spark, f"{folder}/in", max_files=2), f"{folder}/out", f"{folder}/state")
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "index", F.md5("text").alias("text_md5"))


#: What a context goes through before it is summarized; longer words than the guard allows do not reach a summary's beginning.
CLEAN_SQL = r"regexp_replace(regexp_replace({}, '[\x0b\x0c\x1c-\x1f\x{{85}}]', ' ', 'g'), '[^\P{{C}}\n\t\r]+', '', 'g')"
RUN_LEAVES = "leaf AS (SELECT doc_id, index AS ord, index::VARCHAR AS node_id, text FROM nchunked WHERE doc_id IN (SELECT doc_id FROM docs WHERE length(content) BETWEEN 1 AND 500000))"


@query(
    "pipeline_nodes",
    f"WITH RECURSIVE {CHUNKS_NORMALIZED}, {tree_sql(RUN_LEAVES, CLEAN_SQL)} SELECT doc_id, level, ord, node_id, md5(text) AS text_md5 FROM nodes",
)
def pipeline_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over the input documents: guarded, split, normalized, packed, grouped, summarized."""
    config = PipelineConfig(tokenizer_model="characters", embedding_model="mock-model", summarization_model="mock-model", verification_model="mock-model")
    run = pipeline.build(docs(spark, d), config, cluster=clustering.by_order(5))
    return run.nodes.select("doc_id", "level", "ord", "node_id", F.md5("text").alias("text_md5"))


@query(
    "verification_files",
    f"""WITH {tree_sql()} SELECT t.doc_id, n.node_id AS root_id, CASE WHEN length(n.text) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN length(n.text) = 0 THEN 'Skipped' ELSE 'Mock' END AS model_name
  FROM tops t JOIN nodes n ON n.doc_id = t.doc_id AND n.level = t.levels AND n.ord = 0""",
)
def verification_files(spark: SparkSession, d: str) -> DataFrame:
    """Verifications of the roots, written as JSON and read back."""
    nodes, edges, trees = built(spark, d)
    none = nodes.limit(0)
    folder = _folder(spark, "verification")
    pipeline.verifications(pipeline.Run(none, nodes, edges, trees, none, none, none)).write.json(folder)
    v = spark.read.schema("doc_id long, root_id string, verification struct<score: double, model_name: string>").json(folder)
    return v.select("doc_id", "root_id", "verification.score", "verification.model_name")


@query(
    "canvas_file_nodes",
    f"""WITH RECURSIVE {PLACES_SQL}, {width_sql()}, {layout_sql()} SELECT p.doc_id, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.path) - 1)::INTEGER AS node_no, {NAME_SQL.format("p.")} AS id,
    (cx - 200)::INTEGER AS x, (p.depth * 500)::INTEGER AS y, 400 AS width, 200 AS height, md5(CASE WHEN p.is_leaf THEN 'Chunk ' || p.node_id || chr(10) || chr(10) || w.text ELSE w.text END) AS text_md5
  FROM placed p JOIN places w ON w.doc_id = p.doc_id AND w.path = p.path""",
)
def canvas_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each document's canvas file, read back from its JSON."""
    p, nodes = places(spark, d)
    files = export.canvas(export.canvas_nodes(export.layout(export.widths(p)), nodes), export.canvas_edges(p))
    v = F.from_json("canvas", "nodes array<struct<id: string, x: int, y: int, width: int, height: int, type: string, text: string>>")
    return files.select("doc_id", F.posexplode(v["nodes"]).alias("node_no", "n")).select("doc_id", "node_no", "n.id", "n.x", "n.y", "n.width", "n.height", F.md5("n.text").alias("text_md5"))


class Parts:
    """A model that answers in parts, after having failed once in every task."""

    def __init__(self) -> None:
        self.failed = False

    def complete(self, prompt: str) -> object:
        if not self.failed:
            self.failed = True
            raise TimeoutError
        return ["Reply:", {"text": prompt[:12]}, 7]


@query("model_replies", "SELECT DISTINCT node_no, md5('Reply: ' || substring(text, 1, 12) || ' 7') AS reply_md5 FROM summary_nodes WHERE text IS NOT NULL")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """Prompts answered by a model in each task, asked again after a failure, parts joined."""
    ask = providers.language_model(lambda: Parts(), attempts=2, wait=lambda k: 0.0)
    n = table(spark, d, "summary_nodes").where("text is not null").select("node_no", "text").distinct()
    return n.select("node_no", F.md5(ask(F.col("text"))).alias("reply_md5"))


_PARTS = tuple(x.replace("'", "''") for x in T.VERIFY_STEPS)


@query(
    "verification_prompts",
    f"""WITH {tree_sql()}, p AS (SELECT t.doc_id, n.text AS summary, (SELECT string_agg(c.text, chr(10) || chr(10) ORDER BY e.ord) FROM edges e JOIN nodes c ON c.doc_id = e.doc_id AND c.node_id = e.child_id
    WHERE e.doc_id = t.doc_id AND e.parent_id = n.node_id) AS source FROM tops t JOIN nodes n ON n.doc_id = t.doc_id AND n.level = t.levels AND n.ord = 0)
  SELECT doc_id, md5('{_PARTS[0]}' || source || '{_PARTS[1]}' || summary || '{_PARTS[2]}') AS prompt_md5, length(summary)::INTEGER AS summary_chars, length(source)::INTEGER AS source_chars FROM p""",
)
def verification_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a verifier is asked of each root: its children's texts, then its own."""
    p = verify.pairs(*built(spark, d))
    prompt = T.verification_prompt(F.col("source"), F.col("summary"))
    return p.select("doc_id", F.md5(prompt).alias("prompt_md5"), F.length("summary").alias("summary_chars"), F.length("source").alias("source_chars"))


@query(
    "verification_replies",
    """SELECT DISTINCT node_id, score, coalesce(len(details), 0)::INTEGER AS claims, coalesce(details[1].claim, '') AS first_claim, coalesce(len(unsupported_claims), 0)::INTEGER AS unsupported,
    coalesce(model_name, 'gpt-4o') AS model_name FROM verifications WHERE score IS NOT NULL""",
)
def verification_replies(spark: SparkSession, d: str) -> DataFrame:
    """Stored verifications as a model's fenced replies, parsed again; a reply without a score is none."""
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("score", "details", "unsupported_claims", "model_name")), F.lit("\n```"))
    v = table(spark, d, "verifications").select("node_id", verify.parse(reply, "gpt-4o").alias("v")).where("v is not null")
    first = F.coalesce(F.get(F.col("v.details.claim"), F.lit(0)), F.lit(""))
    return v.select("node_id", "v.score", F.size("v.details").alias("claims"), first.alias("first_claim"), F.size("v.unsupported_claims").alias("unsupported"), "v.model_name").distinct()
