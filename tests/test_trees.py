"""Trees, exports, verification, store, pipeline."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from sylvan import cli
from sylvan.config import PipelineConfig
from sylvan.errors import SummarizationError
from sylvan.functions import providers, tokenizers
from sylvan.functions import text as T
from sylvan.operators import clustering, store, tree
from sylvan.plans import export, pipeline, verify
from sylvan.sources import text as sources
from sylvan.sources.node_store import NodeStore
from sylvan.streaming import documents

LEAVES = "doc_id long, ord int, node_id string, text string"


def leaves(spark, sizes):
    return spark.createDataFrame([(d, i, str(i), f"leaf {d}.{i}") for d, n in sizes.items() for i in range(n)], LEAVES)


def test_levels_and_roots(spark):
    nodes, edges, trees = tree.build(leaves(spark, {1: 1, 2: 3, 3: 12, 4: 26}), clustering.by_order(5))
    count = {(r.doc_id, r.level): r["count"] for r in nodes.groupBy("doc_id", "level").count().collect()}
    assert count == {(1, 0): 1, (1, 1): 1, (2, 0): 3, (2, 1): 1, (3, 0): 12, (3, 1): 3, (3, 2): 1, (4, 0): 26, (4, 1): 6, (4, 2): 2, (4, 3): 1}
    assert {r.doc_id: (r.levels, r.status) for r in trees.collect()} == {1: (1, "complete"), 2: (1, "complete"), 3: (2, "complete"), 4: (3, "complete")}
    assert edges.groupBy("doc_id", "child_id").count().where("count > 1").isEmpty()
    assert nodes.where("doc_id = 1 and level = 1").first().text == "leaf 1.0"
    assert nodes.where("doc_id = 2 and level = 1").first().text == "Summary of leaf 2.0\n\nleaf 2.1\n\n..."


def test_levels_that_do_not_shrink(spark):
    alone = lambda nodes: nodes.withColumn("cluster_id", F.col("ord"))
    _, _, trees = tree.build(leaves(spark, {1: 4, 2: 25}), alone)
    assert {r.doc_id: (r.levels, r.status) for r in trees.collect()} == {1: (1, "complete"), 2: (0, "unreduced")}


def test_no_leaves(spark):
    nodes, edges, trees = tree.build(spark.createDataFrame([], LEAVES))
    assert nodes.isEmpty() and edges.isEmpty() and trees.isEmpty()


@pytest.fixture(scope="module")
def dag(spark):
    """A root over two summaries that share a leaf."""
    nodes = spark.createDataFrame([(1, 2, 0, "r", False, "Root text"), (1, 1, 0, "a", False, "A"), (1, 1, 1, "b", False, "B"), (1, 0, 0, "0", True, " zero "), (1, 0, 1, "1", True, "one")], "doc_id long, level int, ord int, node_id string, is_leaf boolean, text string")
    edges = spark.createDataFrame([(1, "r", "a", False, 0), (1, "r", "b", False, 1), (1, "a", "0", True, 0), (1, "a", "1", True, 1), (1, "b", "1", True, 0)], "doc_id long, parent_id string, child_id string, child_is_leaf boolean, ord int")
    trees = spark.createDataFrame([(1, "r", 2, "complete")], "doc_id long, root_id string, levels int, status string")
    return nodes, edges, trees, tree.occurrences(nodes, edges, trees)


def test_markdown(spark, dag):
    nodes, _, _, places = dag
    text = export.markdown(export.markdown_lines(places, nodes)).first().markdown
    assert text == "# Root text\n\n## A\n\n    - **Chunk 0**: zero\n    - **Chunk 1**: one\n## B\n\n    - **Chunk 1**: one"


def test_canvas(spark, dag):
    nodes, _, _, places = dag
    wide = export.widths(places)
    assert {tuple(r.path): r.width for r in wide.collect()} == {(): 1300, (0,): 850, (1,): 400, (0, 0): 400, (0, 1): 400, (1, 0): 400}
    placed = export.layout(wide)
    assert {tuple(r.path): (r.x, r.y) for r in placed.collect()} == {(): (-200, 0), (0,): (-425, 500), (1,): (250, 500), (0, 0): (-650, 1000), (0, 1): (-200, 1000), (1, 0): (250, 1000)}
    edges = [r.id for r in export.canvas_edges(places).orderBy("edge_no").collect()]
    assert edges == ["edge_a_chunk_0", "edge_a_chunk_1", "edge_r_a", "edge_b_chunk_1", "edge_r_b"]
    file = json.loads(export.canvas(export.canvas_nodes(placed, nodes), export.canvas_edges(places)).first().canvas)
    assert [n["id"] for n in file["nodes"]] == ["r", "a", "chunk_0", "chunk_1", "b", "chunk_1"]
    assert file["nodes"][2]["text"] == "Chunk 0\n\n zero " and set(file["edges"][0]) == {"id", "fromNode", "toNode"}


def test_verification(spark, dag):
    nodes, edges, trees, _ = dag
    p = verify.pairs(nodes, edges, trees).first()
    assert (p.summary, p.source) == ("Root text", "A\n\nB")
    good = '```json\n{"score": 0.5, "details": [{"claim": "c", "verdict": "Contradicted", "reasoning": "r"}], "unsupported_claims": ["c"]}\n```'
    rows = spark.createDataFrame([("a", good), ("b", "no json"), ("c", None)], "k string, reply string").select("k", verify.parse(F.col("reply"), "m").alias("v")).collect()
    assert rows[0].v.unsupported_claims == ["c"] and rows[0].v.model_name == "m" and rows[1].v is None and rows[2].v is None
    m = spark.createDataFrame([("x", "y"), ("", "y"), (None, "y")], "s string, t string").select(verify.mock(F.col("s"), F.col("t")).alias("v")).collect()
    assert [(r.v.score, r.v.model_name) for r in m] == [(1.0, "Mock"), (0.0, "Skipped"), (0.0, "Skipped")]


def test_upsert_and_embedding_update(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept")], "id string, version int, text string")
    new = spark.createDataFrame([("a", 2, "new"), ("c", None, "added")], "id string, version int, text string")
    assert {r.id: r.text for r in store.upsert(old, new, ["id"], ["version"]).collect()} == {"a": "new", "b": "kept", "c": "added"}
    n = spark.createDataFrame([("a", None), ("b", [1.0])], "id string, embedding array<float>")
    u = spark.createDataFrame([("a", [0.5]), ("b", None), ("z", [9.0])], "id string, embedding array<float>")
    assert {r.id: r.embedding for r in store.update_embeddings(n, u, "id").collect()} == {"a": [0.5], "b": [1.0]}


def test_node_store_replaces_documents(spark, tmp_path):
    s = NodeStore(spark, str(tmp_path / "store"))
    schema = "doc_id long, level int, ord int, node_id string, is_leaf boolean, text string, cluster_id int"
    s.write("nodes", spark.createDataFrame([(1, 0, 0, "0", True, "a", None), (1, 0, 1, "1", True, "b", None), (2, 0, 0, "x", True, "c", None)], schema))
    s.write("nodes", spark.createDataFrame([(1, 0, 0, "0", True, "new", None)], schema))
    assert sorted((r.doc_id, r.node_id, r.text) for r in s.read("nodes").collect()) == [(1, "0", "new"), (2, "x", "c")]
    assert s.get("x")["text"] == "c" and s.get("missing") is None
    s.update_embeddings(spark.createDataFrame([(1, "0", [0.1]), (1, "1", None)], "doc_id long, node_id string, embedding array<float>"))
    assert [(r.node_id, len(r.embedding)) for r in s.read("embeddings").collect()] == [("0", 1)]


def make_echo():
    class Echo:  # local, so that workers get it by value
        def complete(self, prompt):
            if "fail" in prompt:
                raise TimeoutError("slow")
            return ["reply to", prompt[-3:]]

    return Echo


def test_language_model(spark):
    Echo = make_echo()  # noqa: N806
    ask = providers.language_model(Echo, attempts=2, wait=lambda k: 0.0)
    assert [r[0] for r in spark.createDataFrame([("abc",), (None,)], "p string").select(ask(F.col("p"))).collect()] == ["reply to abc", None]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert providers.with_retries(flaky, 3, lambda k: 0.0) == "ok"
    with pytest.raises(TimeoutError):
        providers.with_retries(lambda: Echo().complete("fail"), 2, lambda k: 0.0)
    assert issubclass(SummarizationError, Exception) and isinstance(Echo(), providers.Client)


def test_pipeline_and_files(spark, tmp_path):
    text = "Climate change is real.\nSea levels are rising.\n" + "海面は上昇している。" * 90
    (tmp_path / "in.txt").write_text(text, encoding="utf-8")
    assert cli.main(["run", str(tmp_path / "in.txt"), str(tmp_path / "out"), "--max-tokens", "120"]) == 0
    assert cli.main(["run", str(tmp_path / "missing.txt"), str(tmp_path / "out2")]) == 1
    assert sorted(os.listdir(tmp_path / "out")) == ["canvas", "markdown", "store", "summary_all.md", "summary_kj.canvas", "verification", "verification_result.json"]
    assert cli.main(["export", str(tmp_path / "out" / "store"), str(tmp_path / "again"), "--format", "markdown"]) == 0
    md = spark.read.json(str(tmp_path / "again" / "markdown")).first().markdown
    assert md.startswith("# Summary of ") and "Climate change is real." in md
    v = spark.read.json(str(tmp_path / "out" / "verification")).first()
    assert v.verification.score == 1.0


def test_pipeline_quarantines(spark):
    docs = spark.createDataFrame([(1, "文。" * 40), (2, None), (3, "x" * 500_001), (4, "   ")], "doc_id long, content string")
    run = pipeline.build(docs, PipelineConfig(tokenizer_model="characters", max_tokens=10), cluster=clustering.by_order(5))
    assert {r.doc_id: r.reason for r in run.rejected.collect()} == {2: "empty", 3: "too long"}
    assert [r.doc_id for r in run.trees.collect()] == [1]
    assert run.embeddings.count() == run.nodes.count()
    with pytest.raises(ValueError, match="maximum allowed length"):
        sources.accepted(docs, fail_fast=True)


def test_one_bad_character_or_word_does_not_blank_a_summary(spark):
    docs = spark.createDataFrame([(1, "Good words.\nSo\u00adft and\u200b zero.\nMore words."), (2, "First words.\n" + "y" * 1500), (3, "Plain words.\nAnd plain."), (4, "z" * 300 + "\n" + "z" * 300)], "doc_id long, content string")
    run = pipeline.build(docs, PipelineConfig(tokenizer_model="characters", max_tokens=10, max_input_length=500_000), cluster=clustering.by_order(5))
    text = {r.doc_id: r.text for r in run.nodes.where("not is_leaf").collect()}
    assert text[1] == "Summary of Good words.\n\nSoft an..." and text[2].startswith("Summary of First words.") and text[3].startswith("Summary of Plain")
    assert sorted((r.doc_id, r.node_id, r.reason) for r in run.problems.collect()) == [(1, "1", "control"), (2, "1", "long word")]
    run = pipeline.build(docs.where("doc_id = 4"), PipelineConfig(tokenizer_model="characters", max_tokens=10, max_input_length=601), cluster=clustering.by_order(5))
    assert [(r.doc_id, r.reason) for r in run.problems.collect()] == [(4, "too long")]
    seen = spark.createDataFrame([("a\x1cb\ufeffc " + "w" * 2001,)], "t string").select(T.clean(F.col("t")).alias("t")).first().t
    assert seen == "a bc " + "w" * 1000 + " " + "w" * 1000 + " w"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "文１。文２。"), (2, "ab\ncd")], documents.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = documents.write_chunks(documents.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), 3)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "index", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "文1。"), (1, 1, "文2。"), (2, 0, "ab"), (2, 1, "cd")]


@pytest.mark.parametrize("bad", [{"max_tokens": 0}, {"clustering_algorithm": "kmeans"}, {"embedding_model": "other"}, {"semantic_chunking_percentile": 101}, {"canvas_node_width": 5}, {"n_clusters": 0}])
def test_config_rejects(bad):
    with pytest.raises(ValueError, match="."):
        PipelineConfig(**bad)


def test_config(monkeypatch):
    monkeypatch.setenv("TOKENIZER_MODEL", "  ")
    monkeypatch.setenv("EMBEDDING_MODEL", "mock-model")
    c = PipelineConfig()
    assert (c.tokenizer_model, c.embedding_model, c.max_tokens) == ("cl100k_base", "mock-model", 500)
    assert PipelineConfig.high_precision().max_tokens == 200
    with pytest.raises(ValueError, match="unknown settings"):
        PipelineConfig.from_dict({"nothing": 1})


def test_chunks_are_measured_by_the_tokenizer_of_the_settings(spark):
    docs = spark.createDataFrame([(1, "The mill grinds corn all day.\n" * 8)], "doc_id long, content string")

    def chunks(**settings):
        return pipeline.build(docs, PipelineConfig(embedding_model="mock-model", **settings), cluster=clustering.by_order(5)).chunks.orderBy("index").collect()

    enc = tokenizers.rank_file("/opt/tokenizers/byte_bpe_50k.tiktoken")
    one = len(enc.encode_ordinary("The mill grinds corn all day."))
    assert [len(r.text) for r in chunks(tokenizer_model="byte_bpe_50k", max_tokens=2 * one)] == [58] * 4
    assert [len(r.text) for r in chunks(tokenizer_model="characters", max_tokens=60)] == [58] * 4
    assert len(chunks(tokenizer_model="byte_bpe_50k", max_tokens=8 * one)) == 1
    with pytest.raises(ValueError, match="tokenizer_model"):
        PipelineConfig(tokenizer_model="nothing")
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenizers.resolve("nothing")
    with pytest.warns(UserWarning, match="not at hand"):
        assert tokenizers.resolve("cl100k_base")[0] == "file"


def test_canvas_and_verifier_settings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Climate change is real.\nSea levels are rising.\n")], "doc_id long, content string")
    config = PipelineConfig(embedding_model="mock-model", tokenizer_model="characters", max_tokens=25, verifier_enabled=False, canvas_node_width=100, canvas_node_height=60, canvas_gap_x=10, canvas_gap_y=40)
    pipeline.save(spark, pipeline.build(docs, config), str(tmp_path / "out"), config=config)
    assert not {"verification", "verification_result.json"} & set(os.listdir(tmp_path / "out"))
    file = json.loads((tmp_path / "out" / "summary_kj.canvas").read_text())
    place = {(n["x"], n["y"]) for n in file["nodes"]}
    assert {(n["width"], n["height"]) for n in file["nodes"]} == {(100, 60)} and place == {(-50, 0), (-105, 100), (5, 100)}
    assert (tmp_path / "out" / "summary_all.md").read_text().startswith("# Summary of ")


def test_models_of_the_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "in.txt").write_text("Climate change is real.\nSea levels are rising.\n")
    monkeypatch.delenv(providers.KEY_VARIABLE, raising=False)
    assert cli.main(["run", str(tmp_path / "in.txt"), "--output-dir", str(tmp_path / "out"), "--model", "gpt-4o"]) == 1
    assert cli.main(["run", str(tmp_path / "in.txt"), "--output-dir", str(tmp_path / "out"), "--no-verify", "--tokenizer", "characters"]) == 0
    assert (tmp_path / "out" / "summary_all.md").exists() and not (tmp_path / "out" / "verification").exists()
    with pytest.raises(SummarizationError, match="LLM not initialized"):
        providers.ChatClient("gpt-4o")
    monkeypatch.setenv(providers.KEY_VARIABLE, "k")
    monkeypatch.setenv(providers.URL_VARIABLE, "http://host/v9/")
    sent = []

    class Reply:
        def __enter__(self):
            return io.BytesIO(b'{"choices": [{"message": {"content": "fine"}}]}')

        def __exit__(self, *_):
            return False

    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda r, timeout: sent.append(r) or Reply())
    assert providers.ChatClient("gpt-4o", 0.5, 77).complete("hello") == "fine"
    body = json.loads(sent[0].data)
    assert sent[0].full_url == "http://host/v9/chat/completions" and (body["model"], body["temperature"], body["max_tokens"]) == ("gpt-4o", 0.5, 77)
    assert providers.chat_model("mock-model") is None and providers.base_url() == "http://host/v9"


def test_public_names():
    import sylvan

    assert all(getattr(sylvan, name) is not None for name in sylvan.__all__) and issubclass(sylvan.SylvanError, Exception)


def test_differing_dimensions_raise_or_are_listed(spark):
    from sylvan.operators import chunking

    rows = spark.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [1.0]), (1, 2, "c", None)], "doc_id long, pos int, sentence string, embedding array<double>")
    assert [tuple(r) for r in chunking.dimension_violations(rows).collect()] == [(1, 1, 1, 2)]
    assert chunking.semantic_chunks(rows).count() >= 1
    with pytest.raises(Exception, match="differ in dimension"):
        chunking.semantic_chunks(rows, strict=True).collect()


def test_more_levels_than_a_fixed_bound_and_growing_levels(spark):
    leaves = spark.createDataFrame([(1, k, str(k), f"t{k}") for k in range(60)], "doc_id long, ord int, node_id string, text string")

    def slow(nodes):  # merges the first two only, so that a level has one node fewer
        return nodes.withColumn("cluster_id", F.greatest(F.col("ord") - 1, F.lit(0)).cast("int")) if nodes.first().n > 20 else clustering.by_order(5)(nodes)

    _, _, trees = tree.build(leaves, slow)
    row = trees.first()
    assert row.status == "complete" and row.levels > 40
    wide = tree.build(leaves, lambda nodes: nodes.withColumn("cluster_id", F.explode(F.array(F.col("ord"), F.col("ord") + 100))))
    assert wide[2].first().status == "unreduced"
