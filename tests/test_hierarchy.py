"""Problem 1 against brute force: random graphs, chains, hubs, dirt."""

import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import graph, hierarchy

SCHEMA = "node_no long, doc_id long, id string, children_indices array<string>"


def nodes(spark, links, extra=()):
    ids = sorted({a for a, _ in links} | {b for _, b in links} | set(extra))
    kids = {i: [] for i in ids}
    for a, b in links:
        kids[a].append(b)
    return spark.createDataFrame([(1000 + 7 * k, k % 3, i, kids[i]) for k, i in enumerate(ids)], SCHEMA), kids


def reach(kids, start):
    seen, stack = set(), list(kids[start])
    while stack:
        x = stack.pop()
        if x in kids and x not in seen:
            seen.add(x)
            stack += kids[x]
    return seen


def hexid(k):
    return f"{k:015x}a"


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_hierarchy(spark, seed, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 64)
    rng = random.Random(seed)
    links = {(hexid(rng.randrange(60)), hexid(rng.randrange(60))) for _ in range(55)}
    chain = [(hexid(100 + k), hexid(101 + k)) for k in range(70)]
    ring = [(hexid(200 + k), hexid(200 + (k + 1) % 9)) for k in range(9)]
    df, kids = nodes(spark, sorted(links) + chain + ring + [(hexid(300), hexid(300)), (hexid(100), hexid(205)), (hexid(203), hexid(400))], [hexid(500)])
    want = {i for i in kids if i in reach(kids, i)}
    assert {r.id for r in hierarchy.cyclic_ids(df).collect()} == want
    rows = {r.id: r for r in hierarchy.hierarchy(df).collect()}
    assert set(rows) == set(kids)
    assert {i for i, r in rows.items() if r.status == "cycle"} == want
    assert rows[hexid(170)].depth == 70 and rows[hexid(170)].root == hexid(100)
    assert rows[hexid(500)].status == "orphan" and rows[hexid(400)].status == "below cycle"
    # entry and exit nest exactly along the forest
    for i, r in rows.items():
        if r.status != "cycle":
            inside = [x for x, s in rows.items() if s.status != "cycle" and s.root == r.root and r.entry < s.entry and s.leave < r.leave]
            assert len(inside) == r.in_tree
    # descendants are those over all parents, through and from cycles
    assert {i: r.descendants for i, r in rows.items()} == {i: len(reach(kids, i)) for i in kids}
    acyclic = {a: [b for b in set(v) if b in kids and b not in want] for a, v in kids.items() if a not in want}
    parents = {a: [p for p, v in acyclic.items() if a in v] for a in acyclic}

    def all_paths(x):
        return [[x]] if not parents[x] else [p + [x] for q in parents[x] for p in all_paths(q)]

    got = sorted(tuple(r.path) for r in hierarchy.paths(df).collect())
    assert got == sorted(tuple(p) for x in acyclic for p in all_paths(x))
    pairs = {(r.ancestor, r.descendant) for r in hierarchy.descendants(df).collect()}
    assert pairs == {(a, b) for a in acyclic for b in reach(acyclic, a)}


def test_dirt(spark):
    rows = [(1, 1, "aaaaaaaaaaaaaaaa", ["0", "123456", "bbbbbbbbbbbbbbbb", None, "nowhere"]), (1, 1, "aaaaaaaaaaaaaaaa", ["0", "123456", "bbbbbbbbbbbbbbbb", None, "nowhere"]),
            (2, 1, "bbbbbbbbbbbbbbbb", None), (3, 1, None, ["aaaaaaaaaaaaaaaa"]), (None, 2, "1234567890123456", ["1234567890123456"])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("parent", F.lit("clash"))
    assert [r.id for r in hierarchy.cyclic_ids(df).collect()] == ["1234567890123456"]
    got = {r.id: (r.status, r.depth, r.descendants) for r in hierarchy.hierarchy(df).collect()}
    assert got == {"aaaaaaaaaaaaaaaa": ("root", 0, 1), "bbbbbbbbbbbbbbbb": ("node", 1, 0), "1234567890123456": ("cycle", None, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy.cyclic_ids(df).isEmpty() and hierarchy.hierarchy(df).isEmpty() and hierarchy.paths(df).isEmpty()


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5), (None, 7)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(50)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + k: 100 for k in range(40)} | {200 + k: 200 for k in range(51)}
    assert got == want


def test_colouring_equals_the_bounded_way(spark):
    rng = random.Random(5)
    links = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(40)})
    e = spark.createDataFrame([(a, 0, b, 0) for a, b in links], "s long, sb long, d long, db long")
    small = {r.node for r in graph.nodes_on_cycles(e).collect()}
    assert small == {r.node for r in graph.nodes_on_cycles(e, component_edges=0).collect()}


def test_hubs_stay_out_of_the_local_step(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_LINKS", 3)
    links = [(0, k) for k in range(1, 8)] + [(7, 0), (5, 6)] + [(k, 20) for k in range(1, 7)] + [(20, 21)]
    e = spark.createDataFrame([(a, 0, b, 0) for a, b in links], "s long, sb long, d long, db long")
    assert {r.node for r in graph.nodes_on_cycles(e).collect()} == {0, 7}


def steps(kids, start):
    seen, front, k = {}, [start], 0
    while front:
        k += 1
        front = sorted({b for a in front for b in kids[a] if b in kids and b not in seen})
        seen |= dict.fromkeys(front, k)
    return seen


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_through_and_from_cycles(spark, seed):
    rng = random.Random(seed)
    links = {(hexid(rng.randrange(40)), hexid(rng.randrange(40))) for _ in range(45)}
    chain = [(hexid(100 + k), hexid(101 + k)) for k in range(21)]
    ring = [(hexid(200 + k), hexid(200 + (k + 1) % 9)) for k in range(9)]
    df, kids = nodes(spark, sorted(links) + chain + ring + [(hexid(300), hexid(300)), (hexid(121), hexid(205)), (hexid(203), hexid(400))])
    got = {(r.ancestor, r.descendant): r.distance for r in hierarchy.reachable(df).collect()}
    assert got == {(a, b): k for a in kids for b, k in steps(kids, a).items()}
    assert got[hexid(100), hexid(400)] == 30 and got[hexid(200), hexid(200)] == 9


def test_colouring_takes_a_row_of_cycles_in_few_rounds(spark, monkeypatch):
    trims, trim = [], graph._trim
    monkeypatch.setattr(graph, "_trim", lambda e: trims.append(1) or trim(e))
    # two-node cycles in a row, ids falling along the links: by ids one cycle would go each round
    links = [x for k in range(12) for x in ((3 * k, 3 * k + 1), (3 * k + 1, 3 * k))] + [(3 * k, 3 * k - 2) for k in range(1, 12)]
    e = spark.createDataFrame([(a, 0, b, 0) for a, b in links], "s long, sb long, d long, db long")
    got = {(r.node, r.cycle) for r in graph._colour(e).collect()}
    assert {n for n, _ in got} == {3 * k + i for k in range(12) for i in (0, 1)} and len({c for _, c in got}) == 12
    assert len(trims) <= 8


def layers(n):
    return [(hexid(2 * k + a), hexid(2 * k + 2 + b)) for k in range(n - 1) for a in (0, 1) for b in (0, 1)]


def test_many_paths_few_descendants(spark):
    df, kids = nodes(spark, layers(30))  # 2^29 paths lead to each node of the last layer
    pairs = {(r.ancestor, r.descendant): r.distance for r in hierarchy.descendants(df).collect()}
    assert pairs == {(a, b): k for a in kids for b, k in steps(kids, a).items()} and len(pairs) == 1740
    assert {r.id: r.descendants for r in hierarchy.hierarchy(df).collect()} == {i: len(reach(kids, i)) for i in kids}


@pytest.mark.parametrize("seed", range(3))
def test_counts_over_all_parents(spark, seed):
    rng = random.Random(seed)
    # trees with few links beside them, so that whole trees hang below the nodes that are followed
    links = {(hexid(rng.randrange(k)), hexid(k)) for k in range(1, 90)} | {(hexid(rng.randrange(60)), hexid(60 + rng.randrange(30))) for _ in range(14)}
    links |= {(hexid(71), hexid(72)), (hexid(72), hexid(71))} if seed else set()
    df, kids = nodes(spark, sorted(links))
    assert {r.id: r.descendants for r in hierarchy.hierarchy(df).collect()} == {i: len(reach(kids, i)) for i in kids}


def test_crowded_blocks_stay_out_of_the_local_step(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_LINKS", 4)
    monkeypatch.setattr(graph, "LAYERS", 0)
    links = [(k, k + 1) for k in range(30)] + [(30, 27), (5, 40), (40, 41), (41, 40)]
    e = spark.createDataFrame([(a, a // 8, b, b // 8) for a, b in links], "s long, sb long, d long, db long")
    assert {r.node for r in graph.nodes_on_cycles(e, component_edges=3).collect()} == {27, 28, 29, 30, 40, 41}
