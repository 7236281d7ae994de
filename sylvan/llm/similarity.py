"""Grouping records into similarity clusters (problem 2).

A hash of a vector is the strongest of 128 fixed random projections, with its sign. Two vectors agree
in a hash the more often the nearer their directions are: in 0.42 of hashes at cosine 0.9, in about 1/256 if they are random.
The stated similarity is the cosine, so candidates are verified by it (exactly, in float64) where the
general method verifies by Jaccard.

Plan, for n records:

* every record goes once to each of its cells, one for each table, with 24 hashes and an int8 form of the vector (88 bytes); rows are
  sorted by cell and number, and inside each band of a cell linked to the first similar row, the leader; a partition holds about a
  fixed number of rows, a task only the leaders of the bands of a cell it is in, so hot groups shrink as they are read;
* candidate links whose cosine the int8 vectors leave open (by a strict bound of their error) are verified on the full vectors by two equi-joins, after the files of the cells' shuffle are deleted;
* connected components of the links form the groups; of a group whose members are not all similar
  to its medoid (the member of highest degree) only those similar to it stay together, and the
  others are clustered anew from their vectors, until no group is loose.

The rule for candidates is the same at every size: two records may be compared if they agree in a cell and in one
of its bands, three hashes together. Of random vectors one pair in two million does so in a band, one in ten thousand in any,
which bounds the comparisons of a record. Each band is worked off for itself and in the order of the numbers. No record drops out
before its cells, so the links, degrees and groups hang on the records alone: not on buffers, files, partitions or on which
cells are split by their bands to bound a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.graph import connected_components
from sylvan.session import cut, drop

DIM = 64
THRESHOLD = 0.9
PROJECTIONS = 128
TABLES, VALUES, BANDS = 8, 24, 24
#: Tables by the number of hashes in a cell key. There is one rule; no number of records changes it.
TABLES_OF = {1: TABLES}
MOST_LEADERS: dict[int, int] = {}
#: Inside the cells of table t the bands are 24 pairs of the 24 values, other pairs for each table.
PAIRS = np.random.default_rng(7).permutation([(i, j) for i in range(VALUES) for j in range(i)])[: TABLES * BANDS].reshape(TABLES, BANDS, 2)
#: Possible error of a cosine taken on int8 vectors; nearer to the threshold only the exact one decides.
MARGIN = 0.006
#: Greatest angle by which whole numbers turn a vector before it is rounded to int8; a test checks the fixed matrix.
TURNED = 0.003
BUFFER = 65_536
#: Rows of one partition of cells, whatever the number of records.
PARTITION_ROWS = 100_000
#: A cell of more leaders is split by its bands. Such cells are found on one in ``SAMPLE`` records; a cell missed only takes more memory.
HOT_ROWS, SAMPLE = 1_600_000, 64


def _whole(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole numbers. No sum of a product of two passes 2**24, so float32 gives it exactly in whatever order it is taken."""
    return np.rint(x * 4000).astype(np.float32)


class Sketcher:
    """Fixed projections; the same on every worker."""

    def __init__(self, cell_rows: int = 1):
        r = np.random.default_rng(20240607)
        self.tables = TABLES_OF[cell_rows]
        # each hash has two bases of its own
        self.axes = [_whole(np.concatenate([np.linalg.qr(r.standard_normal((DIM, DIM)))[0] for _ in range(PROJECTIONS // DIM)], axis=1)) for _ in range(self.tables + VALUES)]
        self.turn = _whole(np.linalg.qr(r.standard_normal((DIM, DIM)))[0])

    def hashes(self, unit: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(unit), len(axes)), np.uint8)
        for a in range(0, len(unit), 2048):
            part = _whole(unit[a : a + 2048])
            rows = np.arange(len(part))
            for k, x in enumerate(axes):
                p = part @ x
                top = np.abs(p).argmax(axis=1)
                out[a : a + 2048, k] = top * 2 + (p[rows, top] > 0)
        return out

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return self.hashes(unit, self.axes[: self.tables]).astype(np.int64) * self.tables + np.arange(self.tables)

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell keys ``[n, tables]`` and further hashes ``[n, VALUES]``."""
        return self.cells(unit), self.hashes(unit, self.axes[self.tables :])

    def int8(self, unit: np.ndarray) -> np.ndarray:
        """The vectors in int8, turned so that no coordinate stands out and coarsens the others."""
        u = _whole(unit) @ self.turn
        return np.rint(u * (127 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)


def band_keys(cell: np.ndarray, values: np.ndarray, pair: np.ndarray) -> np.ndarray:
    v = values[:, pair].astype(np.int64)
    return (cell * (2 * PROJECTIONS) + v[:, 0]) * (2 * PROJECTIONS) + v[:, 1]


def by_key(keys: np.ndarray) -> np.ndarray:
    """Positions sorted by key (not negative), equal keys in order; in one sort of integers where key and position fit."""
    bits = max(1, len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def lead(keys: np.ndarray, cosine, free: np.ndarray, sure: float, least: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Link rows of equal key to leaders. Of each key the first free row leads; free rows whose
    cosine with it is at least ``least`` are linked, and at ``sure`` cease to be free; the others
    go on with the next leader. Changes ``free``. ``known``, which is changed too, holds the leader each row was surely linked to
    last; that link isn't made again. Returns leaders and the rows linked to them."""
    rows = np.flatnonzero(free)
    rows = rows[by_key(keys[rows])]
    a, b = [], []
    while len(rows) > 1:
        k = keys[rows]
        new = np.empty(len(k), bool)
        new[0] = True
        np.not_equal(k[1:], k[:-1], out=new[1:])
        more = ~new
        more[:-1] |= ~new[1:]  # rows that aren't alone with their key
        rows, new = rows[more], new[more]
        if not len(rows):
            break
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        follow, leader = rows[~new], np.repeat(rows[first], size - 1)
        taken = np.zeros(len(follow), bool) if known is None else known[follow] == leader
        ask = np.flatnonzero(~taken)
        c = cosine(leader[ask], follow[ask])
        hit = ask[c >= least]
        a.append(leader[hit])
        b.append(follow[hit])
        hit = ask[c >= sure]
        taken[hit] = True
        if known is not None:
            known[follow[hit]] = leader[hit]
        free[follow[taken]] = False
        rows = follow[~taken]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector (64 finite numbers, not all zero) and their vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    length = np.diff(off)
    ok = np.flatnonzero((length == DIM) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False)
    x = flat[off[ok][:, None] + np.arange(DIM)].astype(np.float64) if len(ok) else np.empty((0, DIM))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ok[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node_no, vec)``: rows that have a number with their unit vector (float32 bytes)."""
    for batch in batches:
        ok, x = _vectors(batch.column(1))
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[ok]
        ok, x = ok[known], x[known]
        if not len(ok):
            continue
        raw = _unit(x).astype(np.float32).tobytes()
        w = DIM * 4
        vec = [raw[i * w : (i + 1) * w] for i in range(len(ok))]
        yield pa.record_batch([batch.column(0).take(pa.array(ok)), pa.array(vec, pa.binary())], names=["node_no", "vec"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(node_no, vec)`` without those similar to an earlier one of their batch. Good for estimates only."""
    sketch = Sketcher()
    for batch in batches:
        u = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIM)
        cells = sketch.cells(u) // TABLES
        free = np.ones(len(u), bool)
        for t in range(TABLES):
            lead(cells[:, t] * (2 * PROJECTIONS) + cells[:, t - 1], lambda i, j, u=u: np.einsum("ij,ij->i", u[i], u[j]), free, THRESHOLD, THRESHOLD)
        yield batch.filter(pa.array(free))


def _spread(cell_rows: int, hot: np.ndarray | None = None):
    """Each record once for each of its cells, with its hashes and int8 vector; in a cell
    that is ``hot`` (sorted) once for each of its bands there, under a negative key of its own. Rows that
    share a band meet either way, so splitting a cell loses no candidate."""
    hot = np.empty(0, np.int64) if hot is None else hot

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(cell_rows)

        def batch_of(cell: np.ndarray, no: np.ndarray, blob: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(cell), pa.array(no), pa.array(blob, pa.binary())], names=["cell", "node_no", "blob"])

        for batch in batches:
            u = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIM)
            no = batch.column(0).to_numpy()
            cells, values = sketch(u)
            blob = np.concatenate([values, sketch.int8(u).view(np.uint8)], axis=1)
            w = blob.shape[1]
            raw = blob.tobytes()
            one = [raw[i * w : (i + 1) * w] for i in range(len(u))]
            for t in range(sketch.tables):
                split = np.isin(cells[:, t], hot)
                if not split.any():
                    yield batch_of(cells[:, t], no, one)
                    continue
                keep = np.flatnonzero(~split)
                yield batch_of(cells[keep, t], no[keep], [one[i] for i in keep])
                some = np.flatnonzero(split)
                few = [one[i] for i in some]
                for k in range(BANDS):
                    yield batch_of(-1 - (band_keys(cells[some, t], values[some], PAIRS[t, k]) * 32 + k), no[some], few)

    return spread


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links ``(a, b, certain)`` inside the cells of a partition sorted by cell and number. A cell too large
    for the buffer is worked off in parts, of which only the rows that lead in a band are kept, with one bit for each such band, which
    changes no link; the parts double, so the leaders are gone through a logarithmic number of times."""
    w = VALUES + DIM

    def link(cell: np.ndarray, no: np.ndarray, blob: np.ndarray, free: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        values, q = blob[:, :VALUES], blob[:, VALUES:].view(np.int8)
        size = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float32))

        def cosine(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            c = np.empty(len(i), np.float32)
            for s in range(0, len(i), 2048):  # stays in the cache
                x, y = i[s : s + 2048], j[s : s + 2048]
                c[s : s + 2048] = np.einsum("ij,ij->i", q[x].astype(np.float32), q[y].astype(np.float32)) / (size[x] * size[y])
            return c

        # equal cells stand together and come in order
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        names = cell[start]
        c = np.repeat(np.arange(len(names)), np.diff(np.append(start, len(cell))))
        bands = int(np.searchsorted(cell, 0))  # rows of cells that are one band already; their keys are negative
        table = cell[bands:] % TABLES
        known = np.full(len(no), -1)
        left = np.zeros(len(no), np.uint32)
        a, b = [], []
        for k in range(BANDS):
            now = (free >> np.uint32(k) & np.uint32(1)).astype(bool)
            keys = c * (2 * PROJECTIONS) ** 2
            at = np.arange(bands, len(no))
            keys[bands:] += values[at, PAIRS[table, k, 0]].astype(np.int64) * (2 * PROJECTIONS) + values[at, PAIRS[table, k, 1]]
            x, y = lead(keys, cosine, now, THRESHOLD + MARGIN, THRESHOLD - MARGIN, known)
            left |= now.astype(np.uint32) << np.uint32(k)
            a.append(x)
            b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        keep = no[x] != no[y]
        x, y = x[keep], y[keep]
        # each of the 64 numbers is rounded by a half at most
        off = np.arcsin(np.minimum(0.5 * np.sqrt(DIM) / size.astype(np.float64), 1)) + TURNED
        certain = np.arccos(np.clip(cosine(x, y).astype(np.float64), -1, 1)) + off[x] + off[y] < np.arccos(THRESHOLD) - 1e-6
        return pa.record_batch([pa.array(np.minimum(no[x], no[y])), pa.array(np.maximum(no[x], no[y])), pa.array(certain)], names=["a", "b", "certain"]), left

    held: list[tuple] = []
    count, full = 0, BUFFER
    for batch in batches:
        blob = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, w)
        cell = batch.column(0).to_numpy()
        # a bit for each band in which the row is free; a cell that is one band has the first only
        held.append((cell, batch.column(1).to_numpy(), blob, np.where(cell < 0, 1, (1 << BANDS) - 1).astype(np.uint32)))
        count += len(blob)
        if count < full:
            continue
        cell, no, blob, free = (np.concatenate(x) for x in zip(*held, strict=True))
        end = int(np.searchsorted(cell, cell[-1]))
        if end:
            links, _ = link(cell[:end], no[:end], blob[:end], free[:end])
            held = [(cell[end:], no[end:], blob[end:], free[end:])]
        else:
            links, left = link(cell, no, blob, free)
            keep = left > 0
            held = [(cell[keep], no[keep], blob[keep], left[keep])]
        yield links
        count = len(held[0][0])
        full = max(BUFFER, 2 * count)
    if count:
        yield link(*(np.concatenate(x) for x in zip(*held, strict=True)))[0]


def _hot(vectors: DataFrame, hot_rows: int, sample: int) -> np.ndarray:
    """Cells that hold more than ``hot_rows`` leaders, as far as one in ``sample`` records tells. Which they are changes no link."""
    some = vectors.where(F.pmod(F.xxhash64("node_no"), F.lit(sample)) == 0).mapInArrow(_thin, "node_no long, vec binary")
    full = some.mapInArrow(_spread(1), "cell long, node_no long, blob binary")
    full = full.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") * sample > hot_rows)
    return np.array(sorted(r[0] for r in full.select("cell").toLocalIterator()), np.int64)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b)`` with the exact cosine of their vectors ``va`` and ``vb``."""
    for batch in batches:
        va, vb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float32).reshape(-1, DIM).astype(np.float64) for k in (2, 3))
        c = np.einsum("ij,ij->i", va, vb) / np.sqrt((va * va).sum(axis=1) * (vb * vb).sum(axis=1))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(c)], names=["a", "b", "c"])


def _pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    one, two = (vectors.select(F.col("node_no").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab")
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, c double")


def records(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    return chunks.select("node_no", "embedding").union(summaries.select("node_no", "embedding"))


def _judge(links: DataFrame, groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(node, medoid, near)`` of each member of a group of two or more. Medoid: the member of most
    links (ties: smallest hash, so that a chain breaks in many places at once)."""
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    ranked = groups.join(degree.hint("merge"), "node", "left").na.fill(0, ["n"])
    first = F.min(F.struct((-F.col("n")).alias("n"), F.xxhash64("node").alias("h"), "node")).alias("m")
    medoid = ranked.groupBy("component").agg(first, F.count("*").alias("size")).where("size > 1").select("component", F.col("m.node").alias("a"))
    pairs = groups.join(medoid.hint("merge"), "component").select("a", F.col("node").alias("b"))
    c = _pair_cosines(pairs.where("a <> b"), vectors).groupBy("a", "b").agg(F.max("c").alias("c"))
    other = c.select(F.col("b").alias("node"), F.col("a").alias("medoid"), (F.col("c") >= THRESHOLD).alias("near"))
    return cut(other.union(medoid.select(F.col("a").alias("node"), F.col("a").alias("medoid"), F.lit(True).alias("near"))))


def _cut(df: DataFrame) -> DataFrame:
    """:func:`cut`, after which the files of the shuffles behind it are deleted; nothing else reads them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def _grouped(rows: DataFrame, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """One round: ``(node, medoid, near)`` of the members of groups, and the records' vectors."""
    # a record delivered twice may stand here twice; its links then repeat and are made distinct below
    vectors = cut(rows.mapInArrow(units, "node_no long, vec binary"))
    n = vectors.count()
    # no cell holds more rows than there are records; each hot one stands for many rows, so they are few
    hot = _hot(vectors, hot_rows, sample) if n > hot_rows else None
    spread = vectors.mapInArrow(_spread(1, hot), "cell long, node_no long, blob binary")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * TABLES // PARTITION_ROWS))
    near = _cut(spread.repartition(parts, "cell").sortWithinPartitions("cell", "node_no").mapInArrow(_cells, "a long, b long, certain boolean").distinct())
    exact = _pair_cosines(near.where("not certain").select("a", "b"), vectors).where(F.col("c") >= THRESHOLD)
    sure = _cut(near.where("certain").select("a", "b").union(exact.select("a", "b")).distinct())
    drop(near)
    return _judge(sure, connected_components(sure).distinct(), vectors), vectors


def clusters(rows: DataFrame, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """``(node_no, first_no)`` of every record of a cluster of two or more, and the records'
    vectors. ``rows``: ``(node_no, embedding)``. Rows with a null number or an unusable embedding
    are left out; a number delivered twice counts once; no usable rows give no clusters. Members not
    similar to their medoid go through the same steps again; each group leaves at least its medoid
    behind, so the rounds end."""
    judged, vectors = _grouped(rows, hot_rows, sample)
    done = judged.where("near").select("node", "medoid")
    while not judged.where("not near").isEmpty():
        loose = judged.where("not near").select(F.col("node").alias("node_no"))
        rest = cut(rows.select("node_no", "embedding").join(loose.hint("merge"), "node_no", "left_semi"))
        judged, _ = _grouped(rest, hot_rows, sample)
        done = done.union(judged.where("near").select("node", "medoid"))
    first = done.groupBy("medoid").agg(F.min("node").alias("first_no"), F.count("*").alias("n")).where("n > 1")
    return done.join(first.select("medoid", "first_no").hint("merge"), "medoid").select(F.col("node").alias("node_no"), "first_no"), vectors


def found(rows: DataFrame) -> DataFrame:
    """``(first_no, node_no)`` of every clustered record but the first of its cluster."""
    return clusters(rows)[0].where("node_no <> first_no").select("first_no", "node_no")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, x = _vectors(batch.column(1))
        first = batch.column(0).to_numpy()[ok]
        names, at = np.unique(first, return_inverse=True)
        total = np.zeros((len(names), DIM))
        np.add.at(total, at, _unit(x))
        yield pa.record_batch([pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), DIM).cast(pa.list_(pa.float64()))], names=["first_no", "s"])


def _to_centre(typical: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cluster in a batch its size there and its ``typical`` members nearest to the mean."""
        for batch in batches:
            ok, x = _vectors(batch.column(2))
            _, s = _vectors(batch.column(3))
            if not len(ok) or len(x) != len(s):
                continue
            c = np.round(np.einsum("ij,ij->i", _unit(x), _unit(s)), 6)
            first, no = batch.column(0).to_numpy()[ok], batch.column(1).to_numpy()[ok]
            order = np.lexsort((no, -c, first))
            first, no, c = first[order], no[order], c[order]
            start = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            size = np.diff(np.append(start, len(first)))
            rank = np.arange(len(first)) - np.repeat(start, size)
            keep = rank < typical
            n = np.where(rank == 0, np.repeat(size, size), 0)
            yield pa.record_batch([pa.array(first[keep]), pa.array(no[keep]), pa.array(c[keep]), pa.array(n[keep])], names=["first_no", "node_no", "c", "n"])

    return near


def describe(rows: DataFrame, typical: int = 3) -> DataFrame:
    """``first_no, size, typical``: each cluster's size and its members nearest to the mean
    direction, nearest first (ties: smaller number). Sums and nearest members are combined before
    each shuffle, so a cluster that holds a third of all rows moves a few rows for each task."""
    found_, _ = clusters(rows)
    found_ = cut(found_)
    mine = rows.where("node_no is not null").dropDuplicates(["node_no"]).join(found_, "node_no")
    part = mine.select("first_no", "embedding").mapInArrow(_sums, "first_no long, s array<double>")
    centre = part.groupBy("first_no").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(DIM)]).alias("s"))
    near = mine.join(centre, "first_no").select("first_no", "node_no", "embedding", "s").mapInArrow(_to_centre(typical), "first_no long, node_no long, c double, n long")
    key = F.struct((-F.col("c")).alias("c"), "node_no")
    salted = near.groupBy("first_no", (F.col("node_no") % 64).alias("salt")).agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.collect_list(key)), 1, typical).alias("t"))
    total = salted.groupBy("first_no").agg(F.sum("n").alias("size"), F.slice(F.sort_array(F.flatten(F.collect_list("t"))), 1, typical).alias("t"))
    return total.select("first_no", F.col("size").cast("long").alias("size"), F.col("t.node_no").alias("typical"))
