"""Distributed graph operators: connected components and nodes on cycles.

Vertices are longs. Every step is a hash aggregation (combined before the shuffle) or an
equi-join; no vertex's neighbourhood is ever gathered into one value, so a hub that touches
a third of all edges only makes one join key hot, which adaptive skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.session import cut, drop

#: Edges of one weak component that one task may hold; larger components go the fully distributed way.
COMPONENT_EDGES = 200_000
#: Out-links of one node from which its links stay out of the block-local step.
HUB_LINKS = 50_000
#: Links of one block from which all of them stay out of it, so that no task holds more.
BLOCK_LINKS = 1_000_000
#: Rounds of joins before blocks are peeled, each a layer of leaves and a layer of roots.
LAYERS = 2


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each batch of edges by stars with the same components (combine before shuffle)."""
    for pdf in batches:
        names, flat = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        n = len(pdf)
        root = _union(len(names), flat[:n], flat[n:])
        keep = root != np.arange(len(names))
        yield pd.DataFrame({"a": names[keep], "b": names[root[keep]]})


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each vertex's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges``; ``component`` is its smallest vertex.

    Alternates large-star and small-star steps (each a min-aggregation and an equi-join) until
    nothing changes. Null ends and self-loops are ignored; no edges give no rows.
    """
    e = (
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .mapInPandas(_local_forest, "a long, b long")
        .distinct()
    )
    e = cut(e)
    for _ in range(max_rounds):
        # large star: link every larger neighbour of u (and u's own side) to u's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: all smaller neighbours of u, and u, to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        nxt = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        # done when every vertex hangs on exactly one other and that one hangs on none
        if nxt.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and nxt.join(nxt.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").isEmpty():
            drop(e)
            e = nxt
            break
        drop(e)
        e = nxt
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _peel_block(leaves: bool):
    """Edges of one block that a block-local peel leaves: drops an edge whose far end lives in
    this block and has no edge left there."""
    near, far = ("s", "d") if leaves else ("d", "s")
    far_block = "db" if leaves else "sb"
    own = "sb" if leaves else "db"

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = (pdf[far_block] == pdf[own]).to_numpy() & ~pdf[f"{far}_far"].to_numpy()
        names, ids = np.unique(np.concatenate([pdf[near].to_numpy(), pdf[far].to_numpy()]), return_inverse=True)
        n = len(pdf)
        x, y = ids[:n], ids[n:]
        live = np.ones(n, bool)
        degree = np.bincount(x, minlength=len(names))
        order = np.argsort(y, kind="stable")
        starts = np.searchsorted(y[order], np.arange(len(names) + 1))
        queue = [v for v in np.unique(y[inside]) if degree[v] == 0]
        while queue:
            v = queue.pop()
            for k in order[starts[v] : starts[v + 1]]:
                if live[k] and inside[k]:
                    live[k] = False
                    degree[x[k]] -= 1
                    if degree[x[k]] == 0:
                        queue.append(x[k])
        return pdf[live]

    return peel


def _layer(e: DataFrame) -> DataFrame:
    """``(s, sb, d, db)`` without links of nodes that lead nowhere or that nothing leads to, one layer of each."""
    e = e.join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "sb", "d", "db")
    return cut(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi").select("s", "sb", "d", "db"))


def _crowded(e: DataFrame, end: str, block: str) -> DataFrame:
    """Ends whose links stay out of the local step: hubs, and all ends of a block with too many links."""
    n = e.groupBy(end, block).agg(F.count("*").alias("n"))
    full = n.where(F.col("n") <= HUB_LINKS).groupBy(block).agg(F.sum("n").alias("all")).where(F.col("all") > BLOCK_LINKS).select(block)
    return n.where(F.col("n") > HUB_LINKS).select(end).union(n.join(full, block, "left_semi").select(end)).distinct()


def peel(edges: DataFrame, rounds: int = 6, enough: int = 0) -> DataFrame:
    """The edges ``(s, sb, d, db)`` that lie on cycles or between cycles, or a superset of them if
    ``rounds`` end first or at most ``enough`` are left. ``sb`` and ``db`` are the blocks of the ends:
    bounded ranges of node numbers, so that after the first layers, which are joins alone, a chain
    inside one block is peeled in one step. Links of hubs and of crowded blocks skip the local step.
    """
    flags = ["s_hub", "d_hub", "s_far", "d_far"]
    schema = "s long, sb long, d long, db long, " + ", ".join(f"{x} boolean" for x in flags)
    e = cut(edges.select("s", "sb", "d", "db").distinct())
    for _ in range(LAYERS):
        e = _layer(e)
        if e.count() <= enough:
            return e
    out, into = _crowded(e, "s", "sb"), _crowded(e, "d", "db")
    # a hub's links are not all in its block's group, so as a far end it counts as alive there
    for name, end, hubs in (("s_hub", "s", out), ("d_hub", "d", into), ("d_far", "d", out.withColumnRenamed("s", "d")), ("s_far", "s", into.withColumnRenamed("d", "s"))):
        e = e.join(hubs.withColumn(name, F.lit(True)), end, "left")
    e = e.na.fill(False, flags).select("s", "sb", "d", "db", *flags)
    count = -1
    for _ in range(rounds):
        for leaves, block, skip in ((True, "sb", "s_hub"), (False, "db", "d_hub")):
            kept = e.where(~F.col(skip)).groupBy(block).applyInPandas(_peel_block(leaves), schema)
            e = kept.union(e.where(skip))
        e = e.join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "sb", "d", "db", *flags)
        e = cut(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi").select("s", "sb", "d", "db", *flags))
        n = e.count()
        if n <= enough or n == count:
            break
        count = n
    return e.select("s", "sb", "d", "db")


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of one bounded group of edges (iterative)."""
    names, ids = np.unique(np.concatenate([pdf["s"].to_numpy(), pdf["d"].to_numpy()]), return_inverse=True)
    n, m = len(names), len(pdf)
    s, d = ids[:m], ids[m:]
    order = np.argsort(s, kind="stable")
    targets = d[order].tolist()
    first = np.searchsorted(s[order], np.arange(n + 1)).tolist()
    index, low, on, comp = [-1] * n, [0] * n, [False] * n, [-1] * n
    stack: list[int] = []
    clock = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        work = [(start, first[start])]
        index[start] = low[start] = clock
        clock += 1
        stack.append(start)
        on[start] = True
        while work:
            v, k = work.pop()
            if k < first[v + 1]:
                work.append((v, k + 1))
                w = targets[k]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, first[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    on[w] = False
                    comp[w] = v
                    if w == v:
                        break
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    comp_a = np.array(comp)
    size = np.bincount(comp_a, minlength=n)
    loop = np.zeros(n, bool)
    loop[s[s == d]] = True
    hit = (size[comp_a] > 1) | loop
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, comp_a, names)
    return pd.DataFrame({"node": names[hit], "cycle": least[comp_a][hit]})


def _trim(e: DataFrame) -> DataFrame:
    """``(s, d)`` without links of nodes that nothing leads to or that lead nowhere, one layer."""
    e = e.join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d")
    return cut(e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi").select("s", "d"))


def _colour(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, fully distributed: spread the largest
    priority forward, take for each colour what its source can reach backward inside the colour,
    repeat on the rest until no links are left. A node's priority is a hash that changes each round, so
    that a row of components falls apart in many places at once; links between colours lie on no
    cycle and go, as does one layer of sources and sinks. Each round takes at least one node away."""
    found = None
    e = cut(edges.select("s", "d").where("s <> d").distinct())
    seed = 0
    while True:
        e = _trim(e)
        if e.isEmpty():
            break
        seed += 1
        nodes = e.select(F.col("s").alias("v")).union(e.select(F.col("d").alias("v"))).distinct()
        held = colour = cut(nodes.select("v", F.struct(F.xxhash64(F.lit(seed), "v").alias("h"), F.col("v").alias("v")).alias("c")))
        while True:
            push = e.join(colour, e["s"] == colour["v"]).groupBy(F.col("d").alias("v")).agg(F.max("c").alias("p"))
            nxt = cut(colour.join(push, "v", "left").select("v", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            drop(held)
            held, colour = nxt, nxt.select("v", "c")
            if not moved:
                break
        cs, cd = colour.select(F.col("v").alias("s"), F.col("c").alias("cs")), colour.select(F.col("v").alias("d"), F.col("c").alias("cd"))
        inner = cut(e.join(cs, "s").join(cd, "d").where("cs = cd").select("s", "d", F.col("cs.v").alias("c")))
        back = cut(colour.where("v = c.v").select("v", F.col("c.v").alias("c")))
        front = back
        while True:
            step = inner.join(front.select(F.col("v").alias("d")), "d").select(F.col("s").alias("v"), "c").distinct().join(back.select("v"), "v", "left_anti")
            front = cut(step)
            if front.isEmpty():
                break
            back = cut(back.union(front))
        got = back.join(back.groupBy("c").agg(F.count("*").alias("n")).where("n > 1"), "c").select(F.col("v").alias("node"), F.col("c").alias("cycle"))
        found = got if found is None else found.union(got)
        gone = back.select("v")
        e = inner.select("s", "d").join(gone.withColumnRenamed("v", "s"), "s", "left_anti").join(gone.withColumnRenamed("v", "d"), "d", "left_anti").select("s", "d")
    loops = edges.where("s = d").select(F.col("s").alias("node"), F.col("s").alias("cycle"))
    return loops if found is None else found.union(loops.join(found.select("node"), "node", "left_anti"))


def nodes_on_cycles(edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """``(node, cycle)`` for each node that can reach itself; ``cycle`` names its strongly connected
    component. ``edges``: ``(s, sb, d, db)`` as in :func:`peel`. Leaves and roots are peeled first.
    What stays is solved in one task if it has at most ``component_edges`` links, else split into weak
    components, of which each within that bound is one task's and a larger one goes to distributed
    colouring. Self-links count as cycles.
    """
    core = peel(edges, enough=component_edges)
    left = core.count()
    if left <= component_edges:
        return core.select("s", "d", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda pdf: _tarjan(pdf), "node long, cycle long")
    loops = core.where("s = d")
    parts = connected_components(core, "s", "d")
    parts = parts.union(loops.select(F.col("s").alias("node"), F.col("s").alias("component")).join(parts.select("node"), "node", "left_anti").distinct())
    marked = cut(core.select("s", "d").join(parts.withColumnRenamed("node", "s"), "s"))
    size = marked.groupBy("component").agg(F.count("*").alias("n"))
    small = marked.join(size.where(F.col("n") <= component_edges).select("component"), "component", "left_semi")
    found = small.groupBy("component").applyInPandas(lambda pdf: _tarjan(pdf), "node long, cycle long")
    large = size.where(F.col("n") > component_edges)
    if large.isEmpty():
        return found
    return found.union(_colour(marked.join(large, "component", "left_semi")))

