"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

A text is encoded as a monoid of parts. A part is either *open* (text without a certain boundary
inside) or *closed*: open text before its first certain boundary, finished token ids, open text
after its last one. Joining two parts encodes only the window between their certain boundaries;
the window grows until it holds one on either side, and ids outside it can no longer change. The
join is associative, so halves are encoded recursively and joined up the tree, and the result is
that of encoding the text at once.

A boundary is certain where an ASCII letter or digit is followed by ASCII white space or
punctuation: no piece of the tokenizer's splitting pattern holds the two together, and no piece's
end looks beyond it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvan.functions.tokenizers import FOLDER
from sylvan.functions.tokenizers import rank_file as encoding

#: Folder of the public vocabularies (see its README).
TOKENIZERS = FOLDER
#: Texts of at most this many characters are leaves of the tree.
LEAF = 8_192
_CERTAIN = re.compile(r"(?<=[A-Za-z0-9])(?=[\t\n\r !-/:-@\[-`{-~])")
_CERTAIN_BACK = 256


def _ids(enc, text: str) -> list[int]:
    return enc.encode_ordinary(text) if text else []


def first_boundary(text: str) -> int:
    m = _CERTAIN.search(text, 1)
    return m.start() if m and m.start() < len(text) else -1


def last_boundary(text: str) -> int:
    span = _CERTAIN_BACK
    while True:
        low = max(0, len(text) - span)
        at = -1
        for m in _CERTAIN.finditer(text, max(1, low)):
            at = m.start()
        if at > 0 or low == 0:
            return at
        span *= 4


#: A part: (open text, None, "") or (text before, list of id arrays, text after).
Part = tuple[str, list | None, str]


def leaf(enc, text: str) -> Part:
    a = first_boundary(text)
    if a < 0:
        return text, None, ""
    b = last_boundary(text)
    return text[:a], [_ids(enc, text[a:b])], text[b:]


def join(enc, x: Part, y: Part) -> Part:
    if x[1] is None and y[1] is None:
        return leaf(enc, x[0] + y[0])
    if x[1] is None:
        grown = leaf(enc, x[0] + y[0])
        return (x[0] + y[0], y[1], y[2]) if grown[1] is None else (grown[0], [*grown[1], _ids(enc, grown[2]), *y[1]], y[2])
    if y[1] is None:
        grown = leaf(enc, x[2] + y[0])
        return (x[0], x[1], x[2] + y[0]) if grown[1] is None else (x[0], [*x[1], _ids(enc, grown[0]), *grown[1]], grown[2])
    return x[0], [*x[1], _ids(enc, x[2] + y[0]), *y[1]], y[2]


def fold(enc, text: str, size: int = LEAF) -> Part:
    if len(text) <= size:
        return leaf(enc, text)
    half = len(text) // 2
    return join(enc, fold(enc, text[:half], size), fold(enc, text[half:], size))


def encode(enc, text: str, size: int = LEAF) -> list[int]:
    """Ids of a whole text. Texts within one leaf are encoded at once."""
    if len(text) <= size:
        return _ids(enc, text)
    before, ids, after = fold(enc, text, size)
    if ids is None:
        return _ids(enc, before)
    return list(chain(_ids(enc, before), *ids, _ids(enc, after)))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` for each row: the ids of its text without special tokens. Text that spells a
    special token is ordinary text; an empty and a null text give an empty list; one row out for
    each row in, repeated rows included. No shuffle."""
    path = os.path.join(folder, vocabulary)
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            values: list[int] = []
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            for k, t in enumerate(batch.column(1)):
                values += encode(enc, t.as_py()) if t.is_valid else []
                offsets[k + 1] = len(values)
            flat = pa.array(np.array(values, np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {key_type}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, tokens)``: the number of tokens of each text."""
    from pyspark.sql import functions as F

    return token_ids(documents, key, text).select(key, F.size("ids").alias("tokens"))
