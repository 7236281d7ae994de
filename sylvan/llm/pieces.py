"""Splitting oversized items at natural boundaries (problem 5).

For each text longer than its limit the positions where it may be cut are collected once, sorted,
for each kind of boundary: paragraph, line, sentence (those of :mod:`sylvan.llm.sentences`), clause,
word, grapheme. Offsets are prefix sums of lengths, so a piece's end is found by binary search for
the last boundary under the limit, the strongest kind first among those that leave the piece at
least half full, else the last of any kind; without any, the piece is cut hard at the limit. The next
piece begins the given overlap before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.sentences import sentences

#: A stronger boundary goes before a later one only if the piece up to it is at least this share of the limit.
FILL = 0.5
#: Breaks of paragraphs and lines, clauses and words, strongest first. Each match's end is a place to cut.
BREAKS = [
    re.compile(r"(?:\r\n|[\n\r\u2028\u2029\x85])(?:[^\S\n\r]*(?:\r\n|[\n\r\u2028\u2029\x85]))+"),
    re.compile(r"\r\n|[\n\r\u2028\u2029\x85]"),
    re.compile(r"[,;:](?=\s)\s+|[、，；：،؛፣]\s*|\s[–—]\s"),
    re.compile(r"\s+"),
]


def trimmed_length(text: str) -> int:
    """Characters without white space of any kind at either end."""
    return len(text.strip())


def _joined(c: str) -> bool:
    """Whether a cut before ``c`` would part a grapheme."""
    return unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "\u200d\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _safe(text: str, at: int, low: int) -> int:
    """The last place at or before ``at`` that parts no grapheme and no line end, if above ``low``."""
    k = at
    while k > low and k < len(text) and (_joined(text[k]) or text[k - 1] == "\u200d" or (text[k] == "\n" and text[k - 1] == "\r")):
        k -= 1
    return k if k > low else at


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, in order. No piece is longer than ``limit``; each
    but the first begins ``overlap`` characters before the end of the one before it (less, by a
    few, never more than ``limit - 1``, where that would part a grapheme or the end would not advance).
    White space at the text's ends belongs to no piece. A text within the limit is one piece; a blank one none.
    """
    begin = len(text) - len(text.lstrip())
    end = len(text.rstrip())
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if begin >= end:
        return []
    if end - begin <= limit:
        return [(begin, end)]
    overlap = max(0, min(overlap, limit - 1))
    paragraph, line, clause, word = ([m.end() for m in kind.finditer(text, begin, end)] for kind in BREAKS)
    cuts = [paragraph, line, [a for a, _ in sentences(text)][1:], clause, word]
    out, start = [], begin
    while True:
        most = start + limit
        if most >= end:
            out.append((start, end))
            return out
        least = start + max(overlap + 1, int(limit * FILL))
        stop = 0
        for kind in cuts:
            k = bisect_right(kind, most)
            if k and kind[k - 1] >= least:
                stop = kind[k - 1]
                break
        if not stop:
            stop = max((kind[k - 1] for kind in cuts if (k := bisect_right(kind, most))), default=0)
        if stop <= start + overlap:
            stop = _safe(text, most, start + overlap)
        out.append((start, stop))
        back = stop - overlap
        if overlap:
            while back < stop and (_joined(text[back]) or text[back - 1] == "\u200d"):
                back += 1
        start = back


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_kind, item_id, piece_no, start_char_idx, end_char_idx, text`` for each item whose text,
    without white space at its ends, is longer than ``max_chars`` of its kind.

    ``items``: ``(item_kind, item_id, text)``, an item delivered twice (same kind and id) once or
    more; it is split once. Null and empty texts, null ids, kinds without a limit and null limits give
    no rows; a null overlap counts as 0. Short texts are dropped in the scan, before Python.
    """
    most = limits.where("max_chars is not null").groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    long = items.where("item_id is not null and text is not null").join(most, "item_kind").where(F.length("text") > F.col("max_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, numbers, starts, ends, out = [], [], [], [], [], []
            for kind, i, text, limit, overlap in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if trimmed_length(text) <= limit:
                    continue
                for n, (s, e) in enumerate(split(text, limit, overlap)):
                    kinds.append(kind)
                    ids.append(i)
                    numbers.append(n)
                    starts.append(s)
                    ends.append(e)
                    out.append(text[s:e])
            cols = [pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(np.array(numbers, np.int32)), pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32)), pa.array(out, pa.string())]
            yield pa.record_batch(cols, names=["item_kind", "item_id", "piece_no", "start_char_idx", "end_char_idx", "text"])

    return long.select("item_kind", "item_id", "text", "max_chars", "overlap_chars").mapInArrow(
        run, "item_kind string, item_id long, piece_no int, start_char_idx int, end_char_idx int, text string"
    )


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``(item_kind, item_id)`` of the items that :func:`pieces` splits, each once."""
    return pieces(items, limits).where("piece_no = 0").select("item_kind", "item_id").distinct()


def items(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Input documents and chunks as ``(item_kind, item_id, text)``."""
    a = documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").alias("item_id"), F.col("content").alias("text"))
    return a.union(chunks.select(F.lit("chunk"), "node_no", "text"))
