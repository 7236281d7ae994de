"""Evaluation texts leaking into training text (problem 8).

The test items form an inverted index: for each term a list of postings (item, BM25 impact) sorted
by item, and over it a shorter list (block of items, greatest impact in the block). Every passage
of every document (64 words, each 12-word run lies whole in one passage) is a query against it in
the manner of block-max WAND: terms are ordered by their greatest impact, the pivot is the first at
which the sum can reach a threshold, and only blocks in the lists from the pivot on are looked at;
of these the ones whose greatest impacts reach their items' threshold are opened and their items
scored. An item's threshold is the least score that any twelve consecutive words of it can reach, so
pruning loses no leak. What stays is verified: at least 12 consecutive words of the item, question
or answer, must stand in the document in order.

The index takes memory in proportion to its postings. It is built of a bounded amount of item text
and its size is checked before it is broadcast; more items mean more passes over the documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
PASSAGE = 64
#: Items of one index, and their text in characters; also the most that is fetched at once.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 40_000, 16_000_000
#: Most bytes of an index; a larger one is built in two halves.
INDEX_BYTES = 384 << 20
#: Consecutive items whose greatest impacts are kept together.
BLOCK = 16
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|U([0-9a-fA-F]{8})|([abfnrtv0]))")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Elements whose tags count as markup. Other angle brackets are code.
_TAGS = (
    "a abbr article b blockquote body br button caption center cite code dd del details div dl dt em figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav ol option p pre q s samp script "
    "section small span strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var wbr"
).split()
_MARKUP = re.compile(r"</?(?:" + "|".join(sorted(_TAGS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>|<!--|-->", re.IGNORECASE)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code is None:
        return " "
    value = int(code, 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else " "


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case, invisible characters, markup and escapes."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = _INVISIBLE.sub("", text)
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def _hashes(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of :data:`RUN` numbers."""
    n = len(numbers) - RUN + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(RUN if n > 0 else 0):
        out = (out ^ numbers[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _slices(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The positions of all the slices, one after another."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class Index:
    """Inverted index of items ``(id, text)``; those of fewer than :data:`RUN` words are left out.

    Postings of term ``t`` are the slice ``first[t]:first[t + 1]`` of ``item`` and ``impact``, those of
    its blocks ``block_first[t]:block_first[t + 1]`` of ``block`` and ``block_impact``.
    """

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, w) for i, t in sorted(items) if t and len(w := words(t)) >= RUN]
        self.ids = np.array([i for i, _ in split], np.int64)
        vocabulary: dict[str, int] = {}
        flat = array("i")
        for _, w in split:
            flat.extend(vocabulary.setdefault(x, len(vocabulary)) for x in w)
        self.vocabulary = vocabulary
        self.numbers = np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)
        self.start = np.concatenate([[0], np.cumsum([len(w) for _, w in split])]).astype(np.int64)
        n, terms = len(split), len(vocabulary)
        length = np.diff(self.start)
        owner = np.repeat(np.arange(n), length)
        # postings: distinct (term, item) with counts, sorted by term, then item
        both, count = np.unique(self.numbers.astype(np.int64) * max(1, n) + owner, return_counts=True)
        term, self.item = both // max(1, n), (both % max(1, n)).astype(np.int32)
        seen = np.bincount(term, minlength=terms)
        self.first = np.concatenate([[0], np.cumsum(seen)]).astype(np.int64)
        norm = K1 * (1 - B + B * length / max(1e-9, length.mean() if n else 1))
        weight = np.log(1 + (n - seen + 0.5) / (seen + 0.5))
        self.impact = (weight[term] * count * (K1 + 1) / (count + norm[self.item])).astype(np.float32)
        # greatest impact of each block in each list, a little raised so that rounding loses nothing
        blocks = -(-n // BLOCK)
        key = term * max(1, blocks) + self.item // BLOCK
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.block = (self.item[at] // BLOCK).astype(np.int32)
        self.block_impact = np.maximum.reduceat(self.impact, at).astype(np.float32) * np.float32(1 + 1e-5) if len(at) else np.empty(0, np.float32)
        self.block_first = np.searchsorted(term[at], np.arange(terms + 1))
        self.term_max = np.zeros(terms + 1, np.float32)
        if len(at):
            self.term_max[:terms] = np.maximum.reduceat(self.block_impact, self.block_first[:-1])
        # the least score of twelve consecutive words: each distinct one counts once
        self.threshold = np.zeros(n, np.float32)
        mine = self.impact[np.argsort(self.item, kind="stable")].astype(np.float64)  # by item, then term
        own = np.concatenate([[0], np.cumsum(np.bincount(self.item, minlength=n))])
        for k in range(n):
            _, place = np.unique(self.numbers[self.start[k] : self.start[k + 1]], return_inverse=True)
            value = mine[own[k] : own[k + 1]]
            run = np.sort(np.lib.stride_tricks.sliding_window_view(place, RUN), axis=1)
            new = np.ones(run.shape, bool)
            new[:, 1:] = run[:, 1:] != run[:, :-1]
            self.threshold[k] = (value[run] * new).sum(axis=1).min() * (1 - 1e-4)
        self.block_threshold = np.array([self.threshold[k : k + BLOCK].min() for k in range(0, n, BLOCK)], np.float32)
        self.least = float(self.threshold.min()) if n else float("inf")
        # hashes of the runs of each item, sorted within it
        self.runs = np.concatenate([np.sort(_hashes(self.numbers[a:b])) for a, b in zip(self.start[:-1], self.start[1:], strict=True)]) if n else np.empty(0, np.uint64)
        self.run_start = np.concatenate([[0], np.cumsum(length - RUN + 1)]).astype(np.int64)

    def nbytes(self) -> int:
        """Bytes of the arrays, and of the vocabulary at most."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + sum(len(w) * 4 + 150 for w in self.vocabulary)

    def passages(self, numbers: np.ndarray) -> np.ndarray:
        """Starts of the passages that hold a window of twelve known words whose greatest possible
        score reaches any threshold. ``numbers``: term numbers of one text after another, each
        followed by -1 (as is every unknown word)."""
        weight = np.where(numbers >= 0, self.term_max[numbers].astype(np.float64), -1e4)
        total = np.concatenate([[0], np.cumsum(weight)])
        window = np.flatnonzero(total[RUN:] - total[:-RUN] >= self.least - 1e-3)
        step = PASSAGE - RUN + 1
        return np.unique(window // step) * step

    def candidates(self, terms: np.ndarray) -> list[int]:
        """Items whose score for the distinct ``terms`` reaches their threshold."""
        terms = terms[np.argsort(self.term_max[terms], kind="stable")]
        most = np.cumsum(self.term_max[terms].astype(np.float64))
        pivot = int(np.searchsorted(most, self.least - 1e-3))
        if pivot == len(terms):
            return []
        rest = most[pivot - 1] if pivot else 0.0
        # blocks of the lists from the pivot on; what lies before it can add ``rest`` at most
        at = _slices(self.block_first[terms[pivot:]], self.block_first[terms[pivot:] + 1])
        blocks, place = np.unique(self.block[at], return_inverse=True)
        bound = np.bincount(place, self.block_impact[at], len(blocks))
        near = bound + rest >= self.block_threshold[blocks]
        blocks, bound = blocks[near], bound[near]
        for k in range(pivot - 1, -1, -1):  # the true block maxima of the lists before the pivot, the greatest first
            if not len(blocks):
                return []
            t = terms[k]
            a, b = self.block_first[t], self.block_first[t + 1]
            p = np.minimum(np.searchsorted(self.block[a:b], blocks), b - a - 1) + a
            bound = bound + np.where(self.block[p] == blocks, self.block_impact[p], 0)
            near = bound + (most[k - 1] if k else 0.0) >= self.block_threshold[blocks]
            blocks, bound = blocks[near], bound[near]
        if not len(blocks):
            return []
        # the blocks that stay are opened: their postings are added up, list by list
        opened = np.zeros(len(self.block_threshold), bool)
        opened[blocks] = True
        at = _slices(self.first[terms], self.first[terms + 1])
        at = at[opened[self.item[at] // BLOCK]]
        items, place = np.unique(self.item[at], return_inverse=True)
        return items[np.bincount(place, self.impact[at], len(items)) >= self.threshold[items]].tolist()

    def search(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Positions in ``numbers`` and items that have a run of words there in common."""
        if len(numbers) < RUN:
            return
        for start in self.passages(numbers).tolist():
            part = numbers[start : start + PASSAGE]
            found = self.candidates(np.unique(part[part >= 0]))
            if not found:
                continue
            hashes = _hashes(part)
            for k in found:
                mine = self.runs[self.run_start[k] : self.run_start[k + 1]]
                at = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
                for a in np.flatnonzero(mine[at] == hashes).tolist():
                    if self._stands(part[a : a + RUN], k):
                        yield start + a, k

    def _stands(self, run: np.ndarray, item: int) -> bool:
        """Whether the run of words stands in the item."""
        w = self.numbers[self.start[item] : self.start[item + 1]]
        places = np.flatnonzero(w[: len(w) - RUN + 1] == run[0])
        return any(np.array_equal(w[p : p + RUN], run) for p in places.tolist())


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return -1


def indexes(rows: list[tuple[int, str]], most: int = INDEX_BYTES) -> Iterator[Index]:
    """The index of the items, in as many parts as keep each within ``most`` bytes (one item at least)."""
    index = Index(rows)
    if index.nbytes() <= most or len(rows) < 2:
        yield index
        return
    half = len(rows) // 2
    yield from indexes(rows[:half], most)
    yield from indexes(rows[half:], most)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", at_once: int = ITEMS_AT_ONCE, most: int = INDEX_BYTES) -> DataFrame:
    """``(key, item_id)``: each document and item with at least 12 consecutive words of the item in
    the document. Null and empty texts, and items of fewer words, match nothing; repeated rows give
    one pair each time they occur (documents have unique ids). Documents are never shuffled; they are
    read and cut into words once for all items that fit one index.
    """
    spark = documents.sparkSession
    schema = f"{key} long, item_id long"
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n, chars = known.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-n // at_once), -(-(chars or 0) // CHARS_AT_ONCE))
    out = None
    for p in range(parts):  # each pass fetches a bounded amount of item text
        rows = [(r[0], r[1]) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).toLocalIterator()]
        for built in indexes(rows, most):
            index = spark.sparkContext.broadcast(built)

            def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
                ix = index.value
                number = _Numbers(ix.vocabulary).__getitem__
                for batch in batches:
                    ids, ends, numbers = [], [], array("i")
                    for i, t in zip(batch.column(0), batch.column(1), strict=True):
                        if t.is_valid and i.is_valid:
                            numbers.extend(map(number, words(t.as_py())))
                            numbers.append(-1)
                            ids.append(i.as_py())
                            ends.append(len(numbers))
                    flat, end = np.frombuffer(numbers, np.int32), np.array(ends)
                    hits = sorted({(int(np.searchsorted(end, at, side="right")), int(ix.ids[k])) for at, k in ix.search(flat)})
                    yield pa.record_batch([pa.array([ids[a] for a, _ in hits], pa.int64()), pa.array([k for _, k in hits], pa.int64())], names=[key, "item_id"])

            part = documents.select(key, "text").mapInArrow(run, schema)
            out = part if out is None else out.union(part)
    return out


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, suite, documents)`` for each item: in how many documents it leaked, 0 included."""
    hit = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").distinct().join(hit, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))
