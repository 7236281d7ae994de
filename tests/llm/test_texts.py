"""One form, pieces, tokens, truncation, leakage, prose."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import leakage, lookalike, pieces, prose, tokens, truncation

SAME = ["été|été", "filter|ﬁlter", "ABC 12|ＡＢＣ　１２", "ガギ|ｶﾞｷﾞ", "が|が", "水門|⽔⾨", "a b|a b", "engine|en​gi­ne", "model|mоdеl", "A-B|A‐B", "x\ny|x\r\ny", "ё|ё", "Kelvin K|Kelvin K", "اﻟ|ال"]
OTHER = ["été|ete", "O0|00", "l1|11", "カ|ガ", "x2|x²", "1|①", "a\nb|a b", "word|Word", "a–b|a-b", "“a”|\"a\"", "1/2|½"]


@pytest.mark.parametrize("pair", SAME)
def test_look_alikes_meet(pair):
    a, b = pair.split("|")
    assert lookalike.canonical(a) == lookalike.canonical(b)


@pytest.mark.parametrize("pair", OTHER)
def test_different_texts_stay_apart(pair):
    a, b = pair.split("|")
    assert lookalike.canonical(a) != lookalike.canonical(b)


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_canonical_is_final(text):
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once
    assert lookalike.canonical(unicodedata.normalize("NFD", text)) == lookalike.canonical(unicodedata.normalize("NFC", text))


def test_letters_of_other_scripts_and_signs_without_a_class():
    for a, b in [("DTWSVCZ", "ᎠᎢᎳᏚᏙᏟᏃ"), ("pu", "ρυ"), ("oun", "օսո"), ("V", "Ѵ"), ("BOA", "ꓐꓳꓮ"), ("HKM", "ⲎⲔⲘ"), ("1:2", "1∶2"), ("a/b", "a∕b"), ("\U000114bb", "\U000114b9\U000114ba"), ("ো", "ো")]:
        assert lookalike.canonical(a) == lookalike.canonical(b)
    for a, b in [("a", "α"), ("-", "−"), ("y", "γ"), ("r", "г"), ("0", "Օ")]:
        assert lookalike.canonical(a) != lookalike.canonical(b)


def test_conflicts_are_found():
    with pytest.raises(lookalike.ConflictError):
        lookalike.check({"α": "A"})
    with pytest.raises(lookalike.ConflictError):
        lookalike.check({"٣": "4"})
    with pytest.raises(lookalike.ConflictError):
        lookalike.check({"O": "0"})
    with pytest.raises(lookalike.ConflictError):
        lookalike.check({"a": "b", "b": "c"})


def test_pairs(spark):
    rows = [(1, "filter"), (2, "ﬁlter"), (2, "ﬁlter"), (3, "filter"), (4, "other"), (5, None), (6, ""), (7, "fi​lter"), (None, "filter")]
    got = sorted(map(tuple, lookalike.pairs(spark.createDataFrame(rows, "node_no long, text string")).collect()))
    assert got == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7)]
    assert lookalike.pairs(spark.createDataFrame([], "node_no long, text string")).isEmpty()
    hot = spark.range(30_000).selectExpr("id AS node_no", "if(id = 7, 'ﬁlter', 'filter') AS text")
    assert lookalike.pairs(hot).count() == 29_999


@given(st.text(alphabet="ab .\n。é👍‍ ", max_size=300), st.integers(2, 40), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_pieces_cover(text, limit, overlap):
    got = pieces.split(text, limit, overlap)
    body = text.strip()
    if not body:
        assert got == []
        return
    assert got[0][0] == len(text) - len(text.lstrip()) and got[-1][1] == len(text.rstrip())
    assert all(0 < e - s <= limit for s, e in got)
    for (_, e), (s, f) in zip(got, got[1:], strict=False):
        assert e - min(overlap, limit - 1) <= s <= e < f


def test_pieces_prefer_paragraphs():
    text = "First part here.\n\nSecond part is longer. It has two sentences."
    assert [text[s:e] for s, e in pieces.split(text, 24, 0)][0] == "First part here.\n\n"
    assert [e - s for s, e in pieces.split("x" * 100, 30, 10)] == [30, 30, 30, 30, 20]


def test_oversized(spark):
    items = spark.createDataFrame([("a", 1, "x" * 11), ("a", 1, "x" * 11), ("a", 2, " " * 50 + "x" * 10), ("a", 3, None), ("b", 4, "x" * 99), ("c", 5, "x" * 99), ("a", None, "x" * 99), ("a", 6, "　" + "x" * 11)], "item_kind string, item_id long, text string")
    limits = spark.createDataFrame([("a", 10, 3), ("b", 98, None), ("c", None, 1)], "item_kind string, max_chars int, overlap_chars int")
    assert sorted(map(tuple, pieces.oversized(items, limits).collect())) == [("a", 1), ("a", 6), ("b", 4)]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")


@given(text=st.text(max_size=200), size=st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_tree_encoding_equals_direct(enc, text, size):
    assert tokens.encode(enc, text, size) == enc.encode_ordinary(text)
    assert enc.decode(tokens.encode(enc, text, size)) == text


@given(parts=st.lists(st.sampled_from(["foo", " bar", "'s", "\n\n  ", "    x", "(", "42", "漢字", "é", " ", "\t", "'re", "it's", "==", "<|endoftext|>"])), size=st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_tree_encoding_of_code(enc, parts, size):
    text = "".join(parts)
    assert tokens.encode(enc, text, size) == enc.encode_ordinary(text)


def test_token_ids(spark, enc):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> is text"), (4, "a b\n" * 9000), (4, "x")]
    got = [(r.doc_id, r.ids) for r in tokens.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted((i, enc.encode_ordinary(t) if t else []) for i, t in rows)
    assert 50256 not in got[2][1]


CUT = ["The bridge was wo", "Der Sensor ist z.", "He said “stop now!", "It fell down and [...]", "broken byte �", "担当者はポネへ行き、古い記録", "She asked Dr.", "Nobody expected it 🧪 after"]
WHOLE = ["The bridge was worn.", "4.2 Notes on Ana and Eva (R-77)", "Ana, Eva, Ida, Olga", "Done. *", "Done! (2/2)", "Done? [3]", "Fine. 🧪", "炉は静かだ。", "第4章　記録（整理番号9）", "It is “fine.”", "Είναι ζεστή;", "…and so it ended. — END", "パ、モ、ヌ"]


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert truncation.ending(text)[0] in ("open", "marked")


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(text):
    assert truncation.ending(text)[0] in ("done", "maybe")


def test_limits_decide_on_dots(spark):
    sentence = "The old mill near the river was reliable for many long days. "
    body = (sentence * 20)[:300]
    rows = [(f"a{k}", "s", body[:300] + "…") for k in range(6)] + [("b", "s", "It was never a fair test…"), ("c", "s", None), ("d", "s", ""), ("e", None, "No end to thi"), (None, "s", "gone wi"), ("f", "s", "Fine.")]
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[:1]], "id string, source string, text string, cut int")
    assert sorted(r.node_id for r in truncation.found(df).collect()) == [f"a{k}" for k in range(6)] + ["e"]
    assert {r.source: (r.texts, r.cut) for r in truncation.rates(df).collect()} == {"s": (8, 6), "": (1, 1)}
    assert ("s", "chars", 300) in {(r.source, r.measure, r.length) for r in truncation.limits(df).collect()}


ITEM = "Question: The choir of Toren sings 1578 verses for Gria, and the mill at Drea grinds 15995 sacks for Kel. How many remain at the end of the day?"


def brute_leaks(docs, items, n=12):
    out = set()
    for i, a in items:
        w = leakage.words(a)
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, b in docs:
            if b:
                v = leakage.words(b)
                if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                    out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + "the of and to".split()
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for k in range(30)] + [(99, ITEM), (100, None), (101, "too short")]
    docs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=200)
        if k % 3:
            src = leakage.words(rng.choice(items[:30])[1])
            a = rng.randrange(len(src))
            words[50:50] = src[a : a + rng.randrange(9, 30)]
        docs.append((k, " ".join(words)))
    marked = "# " + ITEM.upper().replace(" ", "\n# ")
    escaped = 's = "' + ITEM.replace(" ", "\\n\\t") + '"'
    tagged = "".join(f"<b>{w}</b> " for w in ITEM.split())
    docs += [(900, marked), (901, escaped), (902, tagged), (903, "​".join(ITEM)), (904, None), (905, ""), (906, ITEM[:60])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, suite string")
    want = brute_leaks(docs, [x for x in items if x[1]])
    assert {(900, 99), (901, 99), (902, 99), (903, 99)} <= want and not any(a in (904, 905, 906) for a, _ in want)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == want
    assert {tuple(r) for r in leakage.leaks(d, i, at_once=10).collect()} == want
    assert leakage.leaks(d, i.limit(0)).isEmpty()


PROSE = (
    "This page shows how to move the data without losing what is in the queue. Most of the time you will want to start it first. "
    "If the cache stops before the job is done, then it is safe to run the loader by hand. We wrote this because nothing else was stable. "
    "Why does the parser call the index twice? Nobody on the team could say, and the old notes were not of any help. "
)
CODE = "def load(queue, limit=None):\n    rows = []\n    for row in queue:\n        rows.append(row[2:])\n    return rows\n\n" * 5
SALAD = "batch that be header window in as token the buffer shard is with this config for of to a cursor index on it\n" * 8
LISTED = "".join(f"{k}. Item{chr(97 + k % 26)} route;\n" for k in range(60))


def test_prose(spark, sf):
    common = spark.read.parquet(f"{sf}/common_words.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = [(-1, PROSE), (-2, CODE), (-3, SALAD), (-4, LISTED), (-5, None), (-6, ""), (-7, " \n\t"), (-8, CODE[:300] + "\n\n# " + PROSE.replace(". ", ".\n# ")), (-9, "1,2,3\n" * 50), (-10, "担当者は古い記録を何度も調べた。試験のあと観測装置は安定している。" * 5)]
    both = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in prose.statistics(both, common).where("doc_id < 0").collect()}
    assert {k for k, r in got.items() if r.prose_share > 0.5} == {-1, -8, -10}
    assert [got[k].label for k in (-5, -6, -7)] == ["empty"] * 3 and got[-5].words == 0
    assert got[-1].words == len(re.findall(r"\w+", PROSE)) and got[-9].symbol_share > 0.3


def test_mixture_is_repeatable():
    common = frozenset("the of and to in is it that you".split())
    known, label = prose.examples(common)
    rng = np.random.default_rng(0)
    x = known[rng.integers(len(known), size=400)] + rng.normal(0, 0.02, (400, known.shape[1]))
    fit = [prose.Mixture(known.mean(axis=0), known.std(axis=0) + 1e-6).fit(x, known, label).classes(x) for _ in range(2)]
    assert (fit[0] == fit[1]).all()


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string, label string, content string")
    nodes = spark.createDataFrame([], "id string, source string, text string, state string, k long")
    items = spark.createDataFrame([], "item_kind string, item_id long, text string, piece_no int")
    limits = spark.createDataFrame([], "item_kind string, max_chars int, overlap_chars int")
    words = spark.createDataFrame([], "lang string, word string, word_rank int")
    evals = spark.createDataFrame([], "item_id long, suite string, text string, documents long")
    from sylvan.llm import sentences

    for got in (
        tokens.token_ids(docs), truncation.found(nodes), truncation.rates(nodes), truncation.limits(nodes), pieces.pieces(items, limits), pieces.oversized(items, limits),
        prose.statistics(docs, words), leakage.leaks(docs, evals), leakage.report(docs, evals), sentences.split(docs, "doc_id", "text"), lookalike.texts(docs, ["doc_id"], "text"),
    ):
        assert got.isEmpty()


def test_very_long_texts(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long, "x" * 2_000_000)], "doc_id long, text string, blob string")
    assert len(tokens.token_ids(df).first().ids) == 400_001
    assert lookalike.canonical("é" * 500_000) == "é" * 500_000
    assert len(pieces.split(long, 9000, 400)) == 1 + -(-(len(long.strip()) - 9000) // 8600) or len(pieces.split(long, 9000, 400)) > 200
    assert truncation.ending(long)[0] == "open"


def test_ordinary_endings_and_titles_are_not_cuts(spark):
    whole = ["He came home and said no.", "The winner is me.", "She studied art.", "A short heading", "Total cost overview for the second quarter", "Bericht über die Pumpe"]
    cut_ = ["The valve near the", "It was sent to Dr.", "Although the pump fai", "Siehe Abb.", "Wait for the next re[...]"]
    df = spark.createDataFrame([(f"w{k}", "s", t) for k, t in enumerate(whole)] + [(f"x{k}", "s", t) for k, t in enumerate(cut_)], "id string, source string, text string")
    assert sorted(r.node_id for r in truncation.found(df).collect()) == [f"x{k}" for k in range(len(cut_))]


def test_a_title_cut_inside_its_last_word(spark):
    rows = [("a", "The report on the old pump was late."), ("b", "A report about the pump and the valve came."), ("c", "Report on the old pum"), ("d", "Report on the old pump")]
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "id string, source string, text string")
    assert [r.node_id for r in truncation.found(df).collect()] == ["c"]


def test_limit_at_which_whole_texts_pile_up(spark):
    texts = [("x" * (80 + k % 40) + f"{k:04d}.") for k in range(160)] + ["y" * 195 + f"{k:04d}." for k in range(60)]
    df = spark.createDataFrame([(f"n{k}", "s", t) for k, t in enumerate(texts)], "id string, source string, text string")
    got = {(r.measure, r.length, r.texts, r.unfinished) for r in truncation.limits(df).collect()}
    assert ("chars", 200, 60, 0) in got and all(length == 200 for _, length, _, _ in got)


def test_a_large_index_equals_brute_force_in_memory_of_its_postings():
    rng = random.Random(8)
    weights = [1 / (k + 1) for k in range(60_000)]
    pool = rng.choices([f"w{k}" for k in range(60_000)], weights, k=1_200_000)
    items = [(k, " ".join(pool[50 * k : 50 * k + rng.randrange(12, 50)])) for k in range(20_000)]
    docs = []
    for k in range(300):
        words = rng.choices(pool, k=150)
        src = items[rng.randrange(20_000)][1].split()
        if k % 3:
            a = rng.randrange(len(src))
            words[70:70] = src[a : a + rng.randrange(10, 30)]
        docs.append(words)
    index = leakage.Index(items)
    postings = sum(len(set(t.split())) for _, t in items)
    assert index.nbytes() <= 60 * postings + 400 * len(index.vocabulary)
    runs = {}
    for i, t in items:
        w = t.split()
        for a in range(len(w) - 11):
            runs.setdefault(tuple(w[a : a + 12]), set()).add(i)
    for words in docs:
        numbers = np.array([index.vocabulary.get(w, -1) for w in words] + [-1], np.int32)
        want = {i for a in range(len(words) - 11) for i in runs.get(tuple(words[a : a + 12]), ())}
        assert {int(index.ids[k]) for _, k in index.search(numbers)} == want


def test_an_index_over_its_bound_is_built_in_halves(spark):
    items = [(k, " ".join(f"v{(k * 7 + j) % 300}" for j in range(20))) for k in range(40)]
    whole = leakage.Index(items).nbytes()
    parts = list(leakage.indexes(items, whole // 3))
    assert len(parts) > 2 and all(x.nbytes() <= whole // 3 for x in parts) and sorted(i for x in parts for i in x.ids.tolist()) == list(range(40))
    d = spark.createDataFrame([(1, items[3][1]), (2, "nothing here")], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(d, i, most=whole // 3).collect()} == {tuple(r) for r in leakage.leaks(d, i).collect()} >= {(1, 3)}


def test_the_mixture_of_all_segments_does_not_depend_on_their_partition(spark, sf):
    common = spark.read.parquet(f"{sf}/common_words.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.label for r in prose.statistics(docs.repartition(n), common).collect()} for n in (1, 7))
    assert one == many and {"prose", "code", "list", "table"} <= set(one.values())


def test_expectation_sums_equal_the_plain_densities():
    rng = np.random.default_rng(3)
    d = len(prose.FEATURES)
    x = rng.normal(size=(500, d)) @ rng.normal(size=(d, d)) / 3
    model = prose.Mixture(np.zeros(d), np.ones(d))
    cov = np.array([np.cov(rng.normal(size=(40, d)).T) + 0.1 * np.eye(d) for _ in range(4)])
    mu, weight = rng.normal(size=(4, d)), np.array([0.1, 0.2, 0.3, 0.4])
    model.set(mu, cov, weight)
    log = np.stack([np.log(w) - 0.5 * np.einsum("ia,ab,ib->i", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c, w in zip(mu, cov, weight, strict=True)], axis=1)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got, _ = model.shares(prose._squares(x))
    assert np.allclose(got, p)
    sums, _ = model.sums(x)
    assert np.allclose(sums[:, 0], p.sum(axis=0)) and np.allclose(sums[:, 1 : d + 1], p.T @ x)


def test_an_early_boundary_goes_before_a_hard_cut():
    text = "A short first paragraph.\n\n" + "x" * 300
    assert pieces.split(text, 100, 10)[0] == (0, 26)
    assert pieces.split("y" * 300, 100, 10)[0] == (0, 100)


def test_pieces_end_at_sentences_not_at_abbreviations():
    text = "The report of Dr. Ito names nine mills. " + "It was read by Prof. Noor and by nobody else here today. " * 3
    ends = [text[:e].rstrip()[-5:] for _, e in pieces.split(text, 75, 0)[:-1]]
    assert all(x in ("ills.", "oday.") for x in ends)


def test_the_tree_with_small_leaves_on_the_corpus(sf, enc):
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        if text:
            assert tokens.encode(enc, text, 96) == enc.encode_ordinary(text)


def test_few_texts_of_one_length_are_no_limit(spark):
    # three unfinished texts of one length by chance among many lengths, and a real limit of thirty
    texts = ["w" * (50 + k) + " was the" for k in range(200)] + ["v" * 120 + " was the"] * 2 + [f"{k:03d} " + "u" * 300 + " was the" for k in range(30)] + ["A whole text " + "t" * 107 + " it did…"]
    df = spark.createDataFrame([(f"n{k}", "s", t) for k, t in enumerate(texts)], "id string, source string, text string")
    assert {(r.measure, r.length) for r in truncation.limits(df).collect()} == {(m, 312) for m in truncation.MEASURES}
    assert f"n{len(texts) - 1}" not in {r.node_id for r in truncation.found(df).collect()}
