"""Sentences packed into chunks.

Greedy packing carries a running length from sentence to sentence. The fold runs over the array of
lengths of a document as one Arrow-batched pass in linear time (higher-order functions would copy
their accumulator at every step); texts never leave the JVM for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import text as T
from sylvan.functions import vectors as V


def sentence_rows(docs: DataFrame, normalized: bool = False) -> DataFrame:
    """``doc_id, pos, sentence`` of each document (``doc_id, content``). Splitting comes first,
    normalization after; the other way round full-width marks would no longer split."""
    s = T.sentences(F.col("content"))
    parts = docs.where("content is not null").select("doc_id", (T.normalize_each(s) if normalized else s).alias("s"))
    return parts.select("doc_id", F.posexplode("s").alias("pos", "sentence"))


def pack(lengths: list[int], limit: int, breaks: list[bool] | None = None) -> list[int]:
    """Group number of each item: a group ends before the item that would take it over the limit,
    or before which a break stands. An item over the limit forms a group of its own."""
    out, group, held = [], 0, -1
    for k, n in enumerate(lengths):
        n = n or 0
        if held >= 0 and (held + n > limit or (breaks is not None and breaks[k])):
            group, held = group + 1, -1
        held = n if held < 0 else held + n
        out.append(group)
    return out


def _pack_column(lengths: Column, limit: int, breaks: Column | None = None) -> Column:
    @F.pandas_udf("array<int>")
    def fold(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else pack(list(x), limit))

    @F.pandas_udf("array<int>")
    def fold_breaks(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack(list(x), limit, list(y)) for x, y in zip(a, b, strict=True)])

    return fold(lengths) if breaks is None else fold_breaks(lengths, breaks)


def _merge(groups: DataFrame) -> DataFrame:
    """``doc_id, s (sentences), g (their groups)`` to chunks with running offsets."""
    rows = groups.where(F.size("s") > 0)
    # groups are runs, so each is a slice between two places where the number changes
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    runs = rows.withColumn("first", first).withColumn("last", F.concat(F.slice("first", F.lit(2), F.size("first")), F.array(F.size("s"))))
    text = F.transform(F.arrays_zip("first", "last"), lambda x: F.array_join(F.slice("s", x["first"] + 1, x["last"] - x["first"]), ""))
    chunks = runs.select("doc_id", F.posexplode(text).alias("index", "text"))
    w = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return chunks.select("doc_id", "index", "text", (end - F.length("text")).cast("int").alias("start_char_idx"), end.cast("int").alias("end_char_idx"))


def token_chunks(docs: DataFrame, max_tokens: int = 500, normalized: bool = True, counter: Column | None = None) -> DataFrame:
    """Chunks of ``doc_id, content``: sentences in order, joined without a separator, packed until
    the next one would exceed ``max_tokens``. ``counter`` turns the sentence array ``s`` into an array of
    counts; by default one character is one token. Offsets run over the joined sentences. Null and
    blank documents have no chunks."""
    s = T.sentences(F.col("content"))
    rows = docs.where("content is not null").select("doc_id", (T.normalize_each(s) if normalized else s).alias("s"))
    lengths = F.transform("s", F.length) if counter is None else counter
    return _merge(rows.withColumn("g", _pack_column(lengths, max_tokens)))


def adjacent_distances(rows: DataFrame, key: str = "doc_id", order: str = "pos", vector: str = "embedding", strict: bool = False) -> DataFrame:
    """``rows`` with ``distance``: the cosine distance of each vector to the one before it in its
    document; null for the first, and where either is unusable or dimensions differ. With ``strict``
    two vectors of different dimensions raise."""
    w = Window.partitionBy(key).orderBy(order)
    both = rows.withColumn("_before", F.lag(vector).over(w))
    distance = V.cosine_distance(F.col("_before"), F.col(vector))
    if strict:
        distance = F.when(F.size("_before") != F.size(vector), F.raise_error(F.lit("Embeddings differ in dimension")).cast("double")).otherwise(distance)
    return both.withColumn("distance", distance).drop("_before")


def dimension_violations(rows: DataFrame, key: str = "doc_id", order: str = "pos", vector: str = "embedding") -> DataFrame:
    """``key, order, dims, before``: each vector whose dimension is not that of the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    dims = rows.select(key, order, F.size(vector).alias("dims")).withColumn("before", F.lag("dims").over(w))
    return dims.where("dims >= 0 and before >= 0 and dims <> before")


def thresholds(rows: DataFrame, percentile: float = 90, key: str = "doc_id") -> DataFrame:
    """``key, threshold, gaps``: the exact percentile of each document's distances (linear between neighbours)."""
    return rows.where("distance is not null").groupBy(key).agg(F.percentile("distance", F.lit(percentile / 100.0)).alias("threshold"), F.count("*").alias("gaps"))


def semantic_chunks(rows: DataFrame, percentile: float = 90, max_chars: int = 500, strict: bool = False) -> DataFrame:
    """Chunks of ``doc_id, pos, sentence, embedding``: a chunk ends where the distance to the next
    sentence is above the document's percentile (strictly), or where it would exceed ``max_chars``
    characters. One sentence makes one chunk whatever its length."""
    d = adjacent_distances(rows, strict=strict)
    t = thresholds(d, percentile).select("doc_id", "threshold")
    marked = d.join(t, "doc_id", "left").select("doc_id", F.struct("pos", F.col("sentence").alias("s"), F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).alias("b")).alias("x"))
    docs = marked.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    parts = docs.select("doc_id", F.col("x.s").alias("s"), F.col("x.b").alias("b"))
    return _merge(parts.withColumn("g", _pack_column(F.transform("s", lambda x: F.coalesce(F.length(x), F.lit(0))), max_chars, F.col("b"))).drop("b"))


def violations(chunks: DataFrame) -> Column:
    """Names of the rules a chunk row breaks."""
    c = {
        "index": F.col("chunk_index").isNull() | (F.col("chunk_index") < 0),
        "text": F.col("text").isNull() | (F.length(T.trim(F.col("text"))) == 0),
        "start": F.col("start_char_idx").isNull() | (F.col("start_char_idx") < 0),
        "end": F.col("end_char_idx").isNull() | (F.col("end_char_idx") < 0),
        "order": F.col("start_char_idx") > F.col("end_char_idx"),
        "embedding": F.col("embedding").isNotNull() & ((F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull())),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in c.items()]))


def batches(n: int) -> Column:
    """Batch number of the row numbered ``rn`` from 1."""
    if n < 1:
        raise ValueError("n must be at least one")
    return F.floor((F.col("rn") - 1) / n).cast("int")


