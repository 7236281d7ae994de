"""Documents to verified summary trees, and the files a run leaves behind."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.config import PipelineConfig
from sylvan.functions import providers, tokenizers
from sylvan.functions import text as T
from sylvan.operators import chunking, clustering, tree
from sylvan.plans import export, verify
from sylvan.session import cut, write_file
from sylvan.sources import text as sources
from sylvan.sources.node_store import NodeStore


@dataclass
class Run:
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    trees: DataFrame
    embeddings: DataFrame
    rejected: DataFrame
    #: ``doc_id, node_id, reason``: leaves that a summarizer sees cleaned, contexts that it does not see.
    problems: DataFrame


def summarizer(config: PipelineConfig, model: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """Context to summary: cleaned, guarded, sanitized, then the model (the deterministic one without a
    model). A context that is empty, or still too long, gives an empty summary; :func:`problems` names the latter."""

    def run(context: Column) -> Column:
        context = T.clean(context, config.max_word_length)
        bad = T.guard(context, config.max_input_length, config.max_word_length)
        text = T.mock_summary(context) if model is None else model(T.summary_prompt(T.sanitize(context)))
        return F.when(bad.isNotNull(), "").otherwise(text)

    return run


def problems(leaves: DataFrame, nodes: DataFrame, edges: DataFrame, config: PipelineConfig) -> DataFrame:
    """``doc_id, node_id, reason``: each leaf with characters or words that the guard rejects (its
    context is cleaned of them), and each summary whose context is over the length limit."""
    bad = sources.guarded(leaves, "text", config.max_input_length, config.max_word_length).where("problem in ('control', 'long word')")
    size = nodes.select("doc_id", F.col("node_id").alias("child_id"), F.col("is_leaf").alias("child_is_leaf"), F.length(T.clean(F.col("text"), config.max_word_length)).alias("n"))
    context = edges.join(size, ["doc_id", "child_id", "child_is_leaf"], "left").groupBy("doc_id", "parent_id").agg((F.sum(F.coalesce("n", F.lit(0))) + 2 * (F.count("*") - 1)).alias("n"))
    long = context.where(F.col("n") > config.max_input_length).select("doc_id", F.col("parent_id").alias("node_id"), F.lit("too long").alias("reason"))
    # the root of a document of one leaf has the leaf's text and no context
    long = long.join(nodes.where("not is_leaf and text = ''").select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    return bad.select("doc_id", "node_id", F.col("problem").alias("reason")).union(long)


def clusterer(config: PipelineConfig, embed: Callable[[Column], Column]) -> tree.Clusterer:
    """Embeds a level's texts and assigns them softly to the components of a mixture."""

    def cluster(nodes: DataFrame) -> DataFrame:
        vectors = cut(nodes.select("doc_id", "ord", embed(F.col("text")).alias("embedding")))
        p = clustering.mixture(vectors, config.n_clusters, config.random_state, config.large_scale_threshold, config.umap_n_components)
        member = clustering.soft_membership(p, ["doc_id"], "ord", "probabilities", config.clustering_probability_threshold)
        return nodes.join(cut(member.select("doc_id", "ord", "cluster_id")), ["doc_id", "ord"])

    return cluster


def build(documents: DataFrame, config: PipelineConfig | None = None, embed: Callable[[Column], Column] | None = None, model: Callable[[Column], Column] | None = None, cluster: tree.Clusterer | None = None) -> Run:
    """Trees of ``doc_id, content``: chunk, embed, group and summarize level by level to one root."""
    config = config or PipelineConfig()
    embed = embed or providers.embedder_of(config.embedding_model, config.embedding_batch_size)
    good, bad = sources.accepted(documents, config.max_input_length)
    if config.semantic_chunking_mode:
        rows = chunking.sentence_rows(good, normalized=True).withColumn("embedding", embed(F.col("sentence")))
        chunks = chunking.semantic_chunks(cut(rows), config.semantic_chunking_percentile, config.max_tokens, strict=True)
    else:
        chunks = chunking.token_chunks(good, config.max_tokens, counter=tokenizers.counter(config.tokenizer_model))
    chunks = cut(chunks)
    leaves = chunks.select("doc_id", F.col("index").alias("ord"), F.col("index").cast("string").alias("node_id"), "text")
    nodes, edges, trees = tree.build(leaves, cluster or clusterer(config, embed), summarizer(config, model))
    vectors = cut(nodes.select("doc_id", "node_id", embed(F.col("text")).alias("embedding")))
    return Run(chunks, nodes, edges, trees, vectors, bad, cut(problems(leaves, nodes, edges, config)))


def verifications(run: Run, model: Callable[[Column], Column] | None = None, name: str = "gpt-4o") -> DataFrame:
    """``doc_id, root_id, verification, problem``: each root checked against its children's texts."""
    p = verify.pairs(run.nodes, run.edges, run.trees)
    if model is None:
        return p.select("doc_id", "root_id", verify.mock(F.col("summary"), F.col("source")).alias("verification"), F.lit(None).cast("string").alias("problem"))
    reply = cut(p.withColumn("reply", model(T.verification_prompt(F.col("source"), F.col("summary")))))
    v = verify.parse(F.col("reply"), name)
    return reply.select("doc_id", "root_id", v.alias("verification"), F.when(v.isNull(), "reply is not valid JSON").alias("problem"))


def sizes(config: PipelineConfig) -> export.Sizes:
    return export.Sizes(config.canvas_node_width, config.canvas_node_height, config.canvas_gap_x, config.canvas_gap_y)


def save(spark: SparkSession, run: Run, folder: str, model: Callable[[Column], Column] | None = None, config: PipelineConfig | None = None) -> None:
    """The node store, verifications (unless the settings turn them off), Markdown outlines and
    canvases of a run, and its quarantined documents (``rejected``) and texts (``problems``) where
    there are any. A run of one document leaves its files under their plain names as well."""
    config = config or PipelineConfig()
    store = NodeStore(spark, f"{folder}/store")
    for name, rows in (("nodes", run.nodes), ("edges", run.edges), ("trees", run.trees), ("embeddings", run.embeddings)):
        store.write(name, rows)
    if config.verifier_enabled:
        verifications(run, model, config.verification_model).write.mode("overwrite").json(f"{folder}/verification")
    for name, rows in (("rejected", run.rejected), ("problems", run.problems)):
        if not rows.isEmpty():
            rows.write.mode("overwrite").json(f"{folder}/{name}")
    export_files(spark, store, folder, config=config)
    plain_files(spark, folder, config.verifier_enabled)


def export_files(spark: SparkSession, store: NodeStore, folder: str, formats: tuple[str, ...] = ("markdown", "canvas"), config: PipelineConfig | None = None) -> None:
    """Outlines and canvases from a stored run: one row, so one file section, for each document."""
    nodes, edges, trees = store.read("nodes"), store.read("edges"), store.read("trees")
    places = cut(tree.occurrences(nodes, edges, trees))
    if "markdown" in formats:
        export.markdown(export.markdown_lines(places, nodes)).write.mode("overwrite").json(f"{folder}/markdown")
    if "canvas" in formats:
        size = sizes(config or PipelineConfig())
        placed = export.layout(export.widths(places, size), size)
        export.canvas(export.canvas_nodes(placed, nodes, size), export.canvas_edges(places)).write.mode("overwrite").json(f"{folder}/canvas")


#: The files of a single document: table, column and name.
PLAIN = (("markdown", "markdown", "summary_all.md"), ("canvas", "canvas", "summary_kj.canvas"))


def plain_files(spark: SparkSession, folder: str, verified: bool) -> None:
    """``summary_all.md``, ``summary_kj.canvas`` and ``verification_result.json`` in ``folder`` where the
    tables there are of one document; of more, the tables alone hold the files' texts."""
    tables = [*PLAIN, *([("verification", "verification", "verification_result.json")] if verified else [])]
    for name, column, file in tables:
        rows = spark.read.json(f"{folder}/{name}").select(column).limit(2).collect()
        if len(rows) == 1 and rows[0][0] is not None:
            value = rows[0][0]
            text = value if isinstance(value, str) else json.dumps(value.asDict(True), indent=2, ensure_ascii=False)
            write_file(spark, f"{folder}/{file}", text.encode())
