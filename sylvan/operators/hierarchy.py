"""Parent-child links to full hierarchies (problem 1).

Leaves are peeled to expose cycles (:mod:`sylvan.operators.graph`). What is acyclic becomes a
forest over each node's first parent, whose Euler tour is ranked in parallel: tour arcs are
chained inside bounded blocks of node numbers, the chains alone are ranked by pointer jumping,
and the block positions are added back. Entry and exit give depth, root and the nodes below.

A node may have several parents, and may lead to a cycle. Links that the forest does not hold are
marked on the tour, so entry and exit also tell below which nodes there are any; only for these
nodes reachability is followed, the trees below them without such links count by their intervals.
Paths over every parent come from path doubling, in a logarithmic number of rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.graph import nodes_on_cycles
from sylvan.session import cut, drop

#: Node numbers of one block; no task of a block-local step holds more nodes than this.
BLOCK = 1 << 14
#: A child link of at most six decimal digits names a chunk, not a node.
CHUNK_LINK = r"^[0-9]{1,6}$"


def vertices(nodes: DataFrame) -> DataFrame:
    """``(id, v, vb)``: a long for each non-null id (its smallest ``node_no``, or a negative hash
    where that is null) and its block. Rows delivered twice give one vertex."""
    v = F.min(F.coalesce(F.col("node_no"), -F.abs(F.xxhash64("id")) - 1))
    return nodes.where("id is not null").groupBy("id").agg(v.alias("v")).withColumn("vb", F.floor(F.col("v") / BLOCK).cast("long"))


def links(nodes: DataFrame, vertex: DataFrame) -> DataFrame:
    """``(s, sb, d, db, ord)``: each distinct link from an id to a child id that exists. Null
    children, chunk numbers and links to nothing are left out."""
    raw = nodes.where("id is not null").select("id", F.posexplode("children_indices").alias("ord", "child"))
    raw = raw.where(F.col("child").isNotNull() & ~F.col("child").rlike(CHUNK_LINK)).groupBy("id", "child").agg(F.min("ord").alias("ord"))
    ends = raw.join(vertex.select(F.col("id").alias("child"), F.col("v").alias("d"), F.col("vb").alias("db")), "child")
    return ends.join(vertex.select("id", F.col("v").alias("s"), F.col("vb").alias("sb")), "id").select("s", "sb", "d", "db", "ord")


def cyclic_ids(nodes: DataFrame) -> DataFrame:
    """``(id, cycle)``: each id that can be reached from itself; ``cycle`` is the smallest id of
    its strongly connected component. A node that only leads to a cycle is not returned."""
    vertex = cut(vertices(nodes))
    hit = nodes_on_cycles(links(nodes, vertex))
    named = hit.join(vertex.select(F.col("v").alias("node"), "id"), "node")
    return named.select("id", F.min("id").over(Window.partitionBy("cycle")).alias("cycle"))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow tour arcs inside one block. Adds for each arc the head of its chain, its position,
    running depth and running marks in the chain; the chain's last arc also carries where the tour goes on."""
    order = np.argsort(pdf["arc"].to_numpy())
    arc, nxt, w, m = (pdf[c].to_numpy()[order] for c in ("arc", "next", "w", "m"))
    pos = np.searchsorted(arc, nxt)
    inside = (pos < len(arc)) & (arc[np.minimum(pos, len(arc) - 1)] == nxt)
    to = np.where(inside, pos, -1)
    has_pred = np.zeros(len(arc), bool)
    has_pred[to[to >= 0]] = True
    head, at, depth, marks = (np.zeros(len(arc), np.int64) for _ in range(4))
    to_l, w_l, m_l = to.tolist(), w.tolist(), m.tolist()
    for h in np.flatnonzero(~has_pred).tolist():
        k, i, x, y = 0, h, 0, 0
        while i >= 0:
            head[i], at[i] = h, k
            x += w_l[i]
            y += m_l[i]
            depth[i], marks[i] = x, y
            k += 1
            i = to_l[i]
    return pd.DataFrame({"arc": arc, "head": arc[head], "at": at, "x": depth, "y": marks, "onward": np.where(to < 0, nxt, -1), "last": to < 0})


def _rank(arcs: DataFrame) -> DataFrame:
    """``(arc, list, rank, depth, marks)``: rank from the start of each list, running depth and marks.
    ``arcs``: ``(arc, next, w, m, block)``, ``next`` -1 at the end of a list. Each round halves the
    chains before a chain, so the rounds end by themselves; a list that closes on itself raises."""
    chains = cut(arcs.groupBy("block").applyInPandas(_chain, "arc long, head long, at long, x long, y long, onward long, last boolean"))
    # one row for each chain: its length and weights, and the chain before it
    ends = chains.where("last").select("head", (F.col("at") + 1).alias("len"), F.col("x").alias("wt"), F.col("y").alias("mt"), "onward")
    before = ends.where("onward >= 0").select(F.col("onward").alias("head"), F.col("head").alias("prev"), F.col("len").alias("off"), F.col("wt").alias("xoff"), F.col("mt").alias("yoff"))
    sums = ("off", "xoff", "yoff")
    cur = cut(ends.select("head").join(before, "head", "left").na.fill(0, list(sums)).select("head", "prev", *sums, F.coalesce("prev", "head").alias("first")))
    rounds = 0
    while not cur.where("prev is not null").isEmpty():
        if rounds == 64:
            raise RuntimeError("a tour does not end")
        rounds += 1
        up = cur.select(F.col("head").alias("prev"), F.col("prev").alias("prev2"), *(F.col(c).alias(f"{c}2") for c in sums), F.col("first").alias("first2"))
        grown = [(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in sums]
        before, cur = cur, cut(cur.join(up, "prev", "left").select("head", F.col("prev2").alias("prev"), *grown, F.coalesce("first2", "first").alias("first")))
        drop(before)
    whole = chains.join(cur.select("head", *sums, "first"), "head")
    return whole.select("arc", F.col("first").alias("list"), (F.col("at") + F.col("off")).alias("rank"), (F.col("x") + F.col("xoff")).alias("depth"), (F.col("y") + F.col("yoff")).alias("marks"))


def euler(forest: DataFrame, vertex: DataFrame, marked: DataFrame) -> DataFrame:
    """``(v, root, depth, entry, leave, below)`` of each vertex of a forest given as ``(d, s, ord)``,
    child and its one parent; ``below``: whether one of the vertices ``marked`` ``(v)`` is the vertex
    itself or below it. A parent's children come from one row's array, so the sibling window
    holds no more than that row did. Arc ``2i`` enters the vertex with dense index ``i``, ``2i+1`` leaves it."""
    kids = Window.partitionBy("s").orderBy("ord", "d")
    tree = forest.select("d", "s", "ord").withColumn("sib", F.lead("d").over(kids)).withColumn("k", F.row_number().over(kids))
    first = tree.where("k = 1").select(F.col("s").alias("v"), F.col("d").alias("first"))
    own = marked.select("v").distinct().withColumn("m", F.lit(1))
    info = vertex.select("v", "vb").join(first, "v", "left").join(tree.select(F.col("d").alias("v"), F.col("s").alias("parent"), "sib"), "v", "left").join(own, "v", "left").na.fill(0, ["m"])
    down, up = F.col("v") * 2, F.col("v") * 2 + 1
    enter = F.when(F.col("first").isNotNull(), F.col("first") * 2).otherwise(up)
    onward = F.when(F.col("sib").isNotNull(), F.col("sib") * 2).when(F.col("parent").isNotNull(), F.col("parent") * 2 + 1).otherwise(F.lit(-1))

    def arc(number: Column, to: Column, w: int, m: Column) -> Column:
        return F.struct(number.alias("arc"), to.alias("next"), F.lit(w).alias("w"), m.alias("m"), F.col("vb").alias("block"))

    # marks count on entry: between entry and exit lie those below the vertex, without its own
    ranked = _rank(info.select(F.explode(F.array(arc(down, enter, 1, F.col("m")), arc(up, onward, -1, F.lit(0)))).alias("x")).select("x.*"))
    v = F.floor(F.col("arc") / 2).cast("long").alias("v")
    both = ranked.groupBy(v).agg(F.min("rank").alias("entry"), F.max("rank").alias("leave"), F.max("depth").alias("depth"), F.first("list").alias("list"), (F.max("marks") - F.min("marks")).alias("inner"))
    both = both.join(own, "v", "left")
    return both.select("v", F.floor(F.col("list") / 2).cast("long").alias("root"), (F.col("depth") - 1).alias("depth"), "entry", "leave", ((F.col("inner") > 0) | F.col("m").isNotNull()).alias("below"))


def _count(edge: DataFrame, ranks: DataFrame, cyclic: DataFrame, first: DataFrame) -> DataFrame:
    """``(v, n)``: how many nodes each node reaches, itself included only on a cycle, for the nodes
    below which there is a link outside the forest; the others reach their interval alone.

    Reachability is followed among these nodes. A tree that hangs below them without such links
    counts by its interval; one whose first parent is not among them may lie inside another that is
    reached too, so where such a tree is reached the nested intervals of a node are left out."""
    some = cut(ranks.where("below").select("v").union(cyclic.select(F.col("node").alias("v"))))
    inner = edge.join(some.withColumnRenamed("v", "s"), "s", "left_semi").join(some.withColumnRenamed("v", "d"), "d", "left_semi").select("s", "d")
    pairs = cut(closure(inner).select("s", "d"))
    tree = ranks.where("not below").join(first.select(F.col("d").alias("v"), F.col("s").alias("p")), "v", "left")
    tree = tree.join(some.select(F.col("v").alias("p"), F.lit(True).alias("outer")), "p", "left").select(F.col("v").alias("t"), "root", "entry", "leave", F.coalesce("outer", F.lit(False)).alias("outer"))
    hang = edge.join(some.withColumnRenamed("v", "s"), "s", "left_semi").select("s", F.col("d").alias("t")).join(tree, "t")
    reached = pairs.select(F.col("s").alias("v"), F.col("d").alias("s")).union(some.select("v", F.col("v").alias("s"))).distinct().join(hang, "s").drop("s").distinct()
    size = (F.col("leave") - F.col("entry") + 1) / 2
    mixed = reached.where("not outer").select("v", "root").distinct()
    before = F.max("leave").over(Window.partitionBy("v", "root").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1))
    nested = reached.join(mixed, ["v", "root"], "left_semi").withColumn("before", before).where("before is null or before < leave")
    trees = reached.join(mixed, ["v", "root"], "left_anti").select("v", size.alias("n")).union(nested.select("v", size.alias("n")))
    every = trees.union(pairs.select(F.col("s").alias("v"), F.lit(1.0).alias("n"))).groupBy("v").agg(F.sum("n").cast("long").alias("n"))
    return some.join(every, "v", "left").na.fill(0, ["n"])


def hierarchy(nodes: DataFrame) -> DataFrame:
    """One row for each id: ``id, root, depth, entry, leave, in_tree, descendants, parents, status``.

    ``root``, ``depth``, ``entry``, ``leave`` and ``in_tree`` (the nodes between the last two) follow
    the first parent (smallest vertex) of a node that has several. ``descendants`` counts every node
    that can be reached over any links, through and from cycles too; a node on a cycle reaches
    itself. ``status`` is 'cycle' (lies on one; root, depth and interval null), 'below cycle' (a
    parent lies on one; the node starts its own tree), 'orphan' (no parent, no child), 'root' or
    'node'. An empty table gives no rows.
    """
    vertex = cut(_dense(nodes))
    edge = cut(links(nodes, vertex))
    loop = cut(nodes_on_cycles(edge))
    on = loop.select("node")
    acyclic = edge.join(on.withColumnRenamed("node", "s"), "s", "left_anti").join(on.withColumnRenamed("node", "d"), "d", "left_anti")
    first = acyclic.groupBy("d").agg(F.min(F.struct("s", "ord")).alias("p"), F.count("*").alias("parents")).select("d", "p.s", "p.ord", "parents")
    first = cut(first)
    free = vertex.join(on.withColumnRenamed("node", "v"), "v", "left_anti")
    beside = edge.join(first.select("s", "d"), ["s", "d"], "left_anti").select(F.col("s").alias("v"))
    ranks = cut(euler(first, free, beside))
    count = _count(edge, ranks, on, first)
    under = edge.join(on.withColumnRenamed("node", "s"), "s", "left_semi").select(F.col("d").alias("v")).distinct().withColumn("under", F.lit(True))
    name = vertex.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
    all_rows = (
        vertex.select("id", "v")
        .join(ranks, "v", "left")
        .join(name, "root", "left")
        .join(first.select(F.col("d").alias("v"), "parents"), "v", "left")
        .join(under, "v", "left")
        .join(count, "v", "left")
    )
    size = ((F.col("leave") - F.col("entry") - 1) / 2).cast("long")
    status = (
        F.when(F.col("entry").isNull(), "cycle")
        .when(F.col("parents").isNotNull(), "node")
        .when(F.col("under"), "below cycle")
        .when((size == 0) & (F.coalesce("n", F.lit(0)) == 0), "orphan")
        .otherwise("root")
    )
    return all_rows.select(
        "id", F.col("root_id").alias("root"), "depth", "entry", "leave", size.alias("in_tree"), F.coalesce("n", size).alias("descendants"),
        F.coalesce("parents", F.lit(0)).cast("long").alias("parents"), status.alias("status"),
    )


def _dense(nodes: DataFrame) -> DataFrame:
    """:func:`vertices` with non-negative numbers below 2^62, as tour arcs need two for each."""
    v = F.min(F.when(F.col("node_no") >= 0, F.col("node_no")).otherwise(F.abs(F.xxhash64("id") % (1 << 60)) + (1 << 60)))
    return nodes.where("id is not null").groupBy("id").agg(v.alias("v")).withColumn("vb", F.floor(F.col("v") / BLOCK).cast("long"))


def paths(nodes: DataFrame) -> DataFrame:
    """``(id, root, depth, path)``: every full path from a root to a node, over all of its parents,
    ids from the root down. Nodes on cycles have none; a node below a cycle starts its own path.
    Paths double in length each round, so a chain of depth n takes log2(n) rounds; they end where no
    top has parents left. A node has as many rows as paths lead to it.
    """
    vertex = cut(_dense(nodes))
    edge = cut(links(nodes, vertex))
    on = cut(nodes_on_cycles(edge)).select("node")
    free = vertex.join(on.withColumnRenamed("node", "v"), "v", "left_anti")
    up = edge.join(on.withColumnRenamed("node", "s"), "s", "left_anti").join(on.withColumnRenamed("node", "d"), "d", "left_anti").select("s", "d")
    # a segment ends at v, begins at top and holds everything below top; open: top has parents
    has = up.select(F.col("d").alias("top")).distinct().withColumn("open", F.lit(True))
    seg = up.select(F.col("d").alias("v"), F.col("s").alias("top"), F.array("d").alias("seg"))
    tops = free.select("v", F.col("v").alias("top"), F.array().cast("array<bigint>").alias("seg")).join(up.select(F.col("d").alias("v")).distinct(), "v", "left_anti")
    cur = cut(seg.union(tops).join(has, "top", "left").select("v", "top", "seg", F.coalesce("open", F.lit(False)).alias("open")))
    while not cur.where("open").isEmpty():
        head = cur.select(F.col("v").alias("top"), F.col("top").alias("top2"), F.col("seg").alias("seg2"), F.col("open").alias("open2"))
        grown = cur.where("open").join(head, "top").select("v", F.col("top2").alias("top"), F.concat("seg2", "seg").alias("seg"), F.col("open2").alias("open"))
        before, cur = cur, cut(grown.union(cur.where("not open")))
        drop(before)
    full = cut(cur.select(F.monotonically_increasing_id().alias("k"), "v", F.concat(F.array("top"), "seg").alias("p")))
    ids = vertex.select("v", "id")
    named = full.select("k", "v", F.posexplode("p").alias("pos", "n")).join(ids.withColumnRenamed("v", "n"), "n")
    path = named.groupBy("k", "v").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return path.select(F.col("x.id").alias("path")).select(F.element_at("path", -1).alias("id"), F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path")


def closure(edges: DataFrame) -> DataFrame:
    """``(s, d, distance)``: every pair of a node and one that it reaches over one or more links, with
    the shortest distance. A pair further apart than the reach so far has a node exactly that far from
    its start on a shortest way, so the reach doubles each round and ends by itself; its size is its output's.
    """
    cur = cut(edges.select("s", "d", F.lit(1).alias("distance")).distinct())
    reach = 1
    while True:
        far = cur.where(F.col("distance") == reach)
        if far.isEmpty():
            return cur
        onward = cur.select(F.col("s").alias("m"), "d", F.col("distance").alias("more"))
        grown = far.select("s", F.col("d").alias("m")).join(onward, "m").groupBy("s", "d").agg((F.min("more") + reach).cast("int").alias("distance"))
        before, cur = cur, cut(cur.union(grown.join(cur.select("s", "d"), ["s", "d"], "left_anti").select("s", "d", "distance")))
        drop(before)
        reach *= 2


def _named(pairs: DataFrame, vertex: DataFrame) -> DataFrame:
    name = vertex.select("v", "id")
    named = pairs.join(name.select(F.col("v").alias("s"), F.col("id").alias("ancestor")), "s").join(name.select(F.col("v").alias("d"), F.col("id").alias("descendant")), "d")
    return named.select("ancestor", "descendant", "distance")


def descendants(nodes: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)``: every pair of a node and a node below it over all
    parents, with the shortest distance. Links that touch a node on a cycle are left out;
    :func:`reachable` keeps them."""
    vertex = cut(_dense(nodes))
    edge = cut(links(nodes, vertex))
    on = cut(nodes_on_cycles(edge)).select("node")
    acyclic = edge.join(on.withColumnRenamed("node", "s"), "s", "left_anti").join(on.withColumnRenamed("node", "d"), "d", "left_anti")
    return _named(closure(acyclic), vertex)


def reachable(nodes: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)``: every pair of a node and a node that it reaches over one
    or more links, through and from cycles too, with the shortest distance. A node on a cycle is its
    own descendant."""
    vertex = cut(_dense(nodes))
    return _named(closure(links(nodes, vertex)), vertex)
