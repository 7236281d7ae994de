"""Tokenizers by name: public rank files, the encodings that the tokenizer library knows, characters.

Encoders are made once in each worker. An encoding whose vocabulary is not at hand (none can be
fetched without a network) is replaced by :data:`STAND_IN`, with a warning; a name that is no
tokenizer raises.
"""

from __future__ import annotations

import base64
import os
import warnings
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public rank files; the environment may name another.
FOLDER = "/opt/tokenizers"
STAND_IN = "byte_bpe_50k"
#: The splitting pattern of the byte-level vocabularies, as their publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def folder() -> str:
    return os.environ.get("TOKENIZER_FOLDER", "").strip() or FOLDER


@lru_cache(maxsize=4)
def rank_file(path: str):
    """The encoder of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def known(name: str):
    """An encoding of the library, by its own name or that of a model."""
    import tiktoken

    try:
        return tiktoken.get_encoding(name)
    except ValueError:
        return tiktoken.encoding_for_model(name)


def resolve(name: str) -> tuple[str, str]:
    """``(kind, place)`` of a tokenizer: 'characters', a rank 'file', or one 'known' to the library."""
    if name == "characters":
        return "characters", ""
    path = os.path.join(folder(), f"{name}.tiktoken")
    if os.path.exists(path):
        return "file", path
    try:
        known(name)
        return "known", name
    except (KeyError, ValueError):
        raise ValueError(f"unknown tokenizer {name!r}") from None
    except Exception:  # noqa: BLE001  the vocabulary could not be fetched
        path = os.path.join(folder(), f"{STAND_IN}.tiktoken")
        if not os.path.exists(path):
            raise ValueError(f"the vocabulary of {name!r} is not at hand") from None
        warnings.warn(f"the vocabulary of {name} is not at hand; tokens are counted by {STAND_IN}", stacklevel=2)
        return "file", path


def counter(name: str, column: str = "s") -> Column | None:
    """Token counts of each text of an array column (special tokens as plain text), or None for
    characters, which need no encoder."""
    kind, place = resolve(name)
    if kind == "characters":
        return None
    load: Callable = rank_file if kind == "file" else known

    @F.pandas_udf("array<int>")
    def count(a: pd.Series) -> pd.Series:
        enc = load(place)
        return a.map(lambda x: None if x is None else [len(enc.encode_ordinary(y)) for y in x])

    return count(F.col(column))
