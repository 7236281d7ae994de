"""Clusters against brute force, with copies, hot groups, dirt; recall of the bands."""

import numpy as np
import pyarrow as pa
import pytest

from sylvan.llm import similarity as S
from sylvan.operators.graph import _union


def make(rng, sizes, noise=0.05, dim=64):
    out = []
    for n in sizes:
        c = rng.standard_normal(dim)
        for _ in range(n):
            out.append((c + noise * rng.standard_normal(dim) * rng.random()) * rng.uniform(0.1, 10))
    return np.array(out)


def brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= S.THRESHOLD)
    root = _union(len(x), a, b)
    return {(int(r), i) for i, r in enumerate(root) if r != i}


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = make(rng, [1] * 120 + [2] * 20 + [3] * 10 + [9] * 3 + [150], 0.25)
    x = np.concatenate([x, x[:5], x[-40:]])  # copies
    x = x[rng.permutation(len(x))].astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += rows[:30]  # delivered twice
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 64, 0), (5003, [1.0] * 63, 0), (5004, [float("nan")] * 64, 0), (5005, [None] + [1.0] * 63, 0), (None, x[0].tolist(), 0), (5006, [float("inf")] * 64, 0)]
    df = spark.createDataFrame(rows, "node_no long, embedding array<float>, leader int").repartition(5)
    got = {(r.first_no, r.node_no) for r in S.found(df).collect()}
    assert got == brute(x)
    sizes = {r.first_no: (r["size"], list(r.typical)) for r in S.describe(df).collect()}
    want = {}
    for first, node in brute(x):
        want.setdefault(first, {first}).add(node)
    assert {k: v[0] for k, v in sizes.items()} == {k: len(v) for k, v in want.items()}
    assert all(set(t) <= want[k] and len(t) == min(3, len(want[k])) for k, (_, t) in sizes.items())


def test_no_usable_rows(spark):
    df = spark.createDataFrame([(1, None)], "node_no long, embedding array<float>")
    assert S.found(df).isEmpty() and S.found(df.limit(0)).isEmpty() and S.describe(df).isEmpty()


def test_recall_of_one_pair_at_the_threshold():
    rng = np.random.default_rng(9)
    n = 3000
    u = rng.standard_normal((n, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((n, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9 * u + np.sqrt(1 - 0.81) * w
    sketch = S.Sketcher()
    (ca, va), (cb, vb) = sketch(u.astype(np.float32)), sketch(v.astype(np.float32))
    hit = np.zeros(n, bool)
    for t in range(S.TABLES):
        same = ca[:, t] == cb[:, t]
        for i, j in S.PAIRS[t]:
            hit |= same & (va[:, i] == vb[:, i]) & (va[:, j] == vb[:, j])
    assert hit.mean() >= 0.9


def test_a_cell_larger_than_the_buffer(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "BUFFER", 50)
    rng = np.random.default_rng(2)
    x = make(rng, [60, 60], 0.05)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    batch = pa.record_batch([pa.array(np.arange(120)), pa.array([r.tobytes() for r in u], pa.binary())], names=["node_no", "vec"])
    table = pa.Table.from_batches(list(S._spread(1)(iter([batch])))).sort_by([("cell", "ascending"), ("node_no", "ascending")])
    pairs = set()
    for b in S._cells(iter(table.to_batches(max_chunksize=20))):
        pairs |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    a, b = np.array(sorted(pairs)).T
    assert len(set(_union(120, a, b).tolist())) == 2


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("cell_rows", sorted(S.TABLES_OF))
def test_recall_at_the_threshold_at_every_size(cell_rows, split):
    rng = np.random.default_rng(9)
    n = 3000
    u = rng.standard_normal((n, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((n, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = (0.9 + 1e-6) * u + np.sqrt(1 - (0.9 + 1e-6) ** 2) * w
    both = np.stack([u, v], axis=1).reshape(-1, 64).astype(np.float32)
    batch = pa.record_batch([pa.array(np.arange(2 * n)), pa.array([r.tobytes() for r in both], pa.binary())], names=["node_no", "vec"])
    hot = None
    if split:  # half of all cells, the larger ones
        cells, _ = S.Sketcher(cell_rows)(both)
        names, size = np.unique(cells, return_counts=True)
        hot = np.sort(names[np.argsort(-size)][: len(names) // 2])
    table = pa.Table.from_batches(list(S._spread(cell_rows, hot)(iter([batch])))).sort_by([("cell", "ascending"), ("node_no", "ascending")])
    pairs = {(a, b) for x in S._cells(iter(table.to_batches(max_chunksize=10_000))) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    assert sum((2 * i, 2 * i + 1) in pairs for i in range(n)) >= 0.9 * n


def test_loose_groups_are_split_around_medoids(spark):
    step = np.arccos(0.92)
    flat = np.zeros((41, 64))
    # a fan whose smallest member is the medoid, with a tail; two rows at the tail's end are copies
    angles = np.concatenate([[0, step, -step, step * 0.9, -step * 0.9], step * np.arange(2, 9), [8 * step]])
    flat[: len(angles), 0], flat[: len(angles), 1] = np.cos(angles), np.sin(angles)
    a = step / 6 * np.arange(28)  # a chain in another plane
    far = len(angles)
    flat[far : far + 28, 2], flat[far : far + 28, 3] = np.cos(a), np.sin(a)
    x = flat[: far + 28]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_no long, embedding array<double>")
    for parts in (1, 7):
        groups = {}
        for r in S.found(df.repartition(parts)).collect():
            groups.setdefault(r.first_no, {r.first_no}).add(r.node_no)
        assert sum(map(len, groups.values())) == len(set().union(*groups.values()))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for g in groups.values():
            m = sorted(g)
            assert ((u[m] @ u[m].T) >= S.THRESHOLD - 1e-6).all(axis=1).any()
        assert any({far - 2, far - 1} <= g for g in groups.values())


@pytest.mark.parametrize("cell_rows", sorted(S.TABLES_OF))
def test_single_pairs_across_buffers_at_every_size(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(S, "MOST_LEADERS", {k: 0 if k < cell_rows else 1 << 60 for k in (1, 2)})
    rng = np.random.default_rng(19)
    n = 1500
    u = rng.standard_normal((n, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((n, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.902 * u + np.sqrt(1 - 0.902**2) * w
    # the two rows of a pair lie far apart, in other tasks and buffers
    one = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "node_no long, embedding array<double>").coalesce(1)
    two = spark.createDataFrame([(n + i, x.tolist()) for i, x in enumerate(v)], "node_no long, embedding array<double>").coalesce(1)
    members, _ = S.clusters(one.union(two), hot_rows=20, sample=2)
    got = {(r.first_no, r.node_no) for r in members.where("node_no <> first_no").collect()}
    assert len(got & {(i, n + i) for i in range(n)}) >= 0.9 * n


def _cell_table(x, hot=None):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    batch = pa.record_batch([pa.array(np.arange(len(u))), pa.array([r.tobytes() for r in u], pa.binary())], names=["node_no", "vec"])
    return pa.Table.from_batches(list(S._spread(1, hot)(iter([batch])))).sort_by([("cell", "ascending"), ("node_no", "ascending")])


def test_links_are_the_same_in_whole_and_split_cells_and_in_every_buffer(monkeypatch):
    rng = np.random.default_rng(12)
    # loose chains, in which a link more or less changes what is joined, and tight groups
    x = np.concatenate([make(rng, [40] * 5 + [9] * 20, 0.3), make(rng, [60, 60], 0.02)])
    step = np.cumsum(rng.standard_normal((300, 64)) * 0.2, axis=0) + 2 * rng.standard_normal(64)
    x = np.concatenate([x, step])
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells, _ = S.Sketcher()(u)
    names = np.unique(cells)
    got = []
    for hot, buffer in ((None, 1 << 16), (None, 40), (names, 1 << 16), (names, 40), (names[::2], 40)):
        monkeypatch.setattr(S, "BUFFER", buffer)
        links = set()
        for b in S._cells(iter(_cell_table(x, hot).to_batches(max_chunksize=25))):
            links |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        got.append(links)
    assert len(got[0]) > 500 and all(g == got[0] for g in got)


def test_unrelated_vectors_are_seldom_compared():
    """The share of pairs compared, times the records, is the work for a record; it must stay small at a hundred million."""
    rng = np.random.default_rng(31)
    n = 20_000
    u = rng.standard_normal((n, 64))
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    cells, values = S.Sketcher()(u)
    pairs = 0
    for t in range(S.TABLES):
        for pair in S.PAIRS[t]:
            size = np.unique(S.band_keys(cells[:, t], values, pair), return_counts=True)[1].astype(np.int64)
            pairs += int((size * (size - 1) // 2).sum())
    assert pairs / (n * (n - 1) / 2) < 2e-4


def test_groups_hang_on_the_records_alone(spark):
    """Not on which records share a buffer or a file, on cells that are split, or on the size of the rest of the table."""
    rng = np.random.default_rng(3)
    n = 700

    def near(x, s):
        g = rng.standard_normal(x.shape)
        y = x / np.linalg.norm(x, axis=1, keepdims=True) + s * g / np.linalg.norm(g, axis=1, keepdims=True)
        return y * rng.uniform(0.1, 10, (len(x), 1))

    base = rng.standard_normal((n, 64))
    step = np.cumsum(rng.standard_normal((12, 64)) * 0.2, axis=0) + 2 * rng.standard_normal(64)  # a chain: similar, but not mutually
    x = np.concatenate([near(base, 0.33), near(base, 0.33), near(base, 0.33), step])
    more = rng.standard_normal((6000, 64))  # unrelated to all others

    def table(v, first, parts):
        return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(v)], "node_no long, embedding array<double>").coalesce(parts)

    apart = table(x[:n], 0, 1).union(table(x[n : 2 * n], n, 1)).union(table(x[2 * n :], 2 * n, 2))
    one = table(x, 0, 1)
    got = []
    for rows, hot in ((one, S.HOT_ROWS), (apart, 20), (one.union(table(more, len(x), 3)).repartition(5), S.HOT_ROWS)):
        members, _ = S.clusters(rows, hot_rows=hot, sample=2)
        got.append({(r.first_no, r.node_no) for r in members.collect()})
    assert len(got[0]) > n and all(g == got[0] for g in got), [len(g ^ got[0]) for g in got]


def test_a_hot_group_shrinks_to_the_leaders_of_its_bands(monkeypatch):
    batches = _cell_table(make(np.random.default_rng(5), [3000], 0.02)).to_batches(max_chunksize=50)
    concatenate, most = np.concatenate, 0

    def watch(arrays, *args, **kwargs):
        nonlocal most
        out = concatenate(arrays, *args, **kwargs)
        most = max(most, len(out) if out.ndim == 2 else 0)
        return out

    def links():
        return {(a, b) for x in S._cells(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}

    whole = links()
    monkeypatch.setattr(S, "BUFFER", 100)
    monkeypatch.setattr(S.np, "concatenate", watch)
    assert links() == whole and most < 1000


def test_links_called_certain_are_similar_however_vectors_are_rounded():
    sketch = S.Sketcher()
    # rounding of a unit vector to 1/4000 and the matrix that turns it
    turn = np.linalg.svd(sketch.turn.astype(np.float64) / 4000 - np.linalg.qr(sketch.turn.astype(np.float64))[0] * np.sign(np.diag(np.linalg.qr(sketch.turn.astype(np.float64))[1])), compute_uv=False).max()
    assert turn + 0.5 * 8 / 4000 < S.TURNED
    rng = np.random.default_rng(8)
    u = rng.standard_normal((6000, 64)) * np.where(rng.random((6000, 64)) < 0.1, 8, 1)  # some numbers stand out
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = rng.uniform(0.885, 0.96, (6000, 1))
    both = np.stack([u, c * u + np.sqrt(1 - c * c) * w], axis=1).reshape(-1, 64)
    certain = {}
    for b in S._cells(iter(_cell_table(both).to_batches())):
        certain |= {x: z for x, y, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if x % 2 == 0 and y == x + 1}
    cosines = dict(zip(range(0, 12000, 2), c[:, 0], strict=True))
    assert all(cosines[x] >= S.THRESHOLD for x, z in certain.items() if z)
    assert all(z for x, z in certain.items() if cosines[x] > 0.94) and not all(z for x, z in certain.items() if cosines[x] > 0.9)
