"""Visually identical text with different characters (problem 6).

A transducer over grapheme clusters brings text to one form in one pass: it takes the longest
match at each place, a run of carriage return and line feed, a base with its combining marks, or
a single mapped code point, and leaves everything else as it is. Its table is compiled once from
rules over the Unicode character database plus the fixed look-alike letters below, and checked for
conflicts: no result may itself be mapped further, and letters and digits that differ to the eye
(such as O and 0, or é and e) must keep different results.

Kept apart, since a reader sees the difference: case, accents, superscripts, circled numbers,
fractions, dashes of another length, quotation marks of another shape, tabs and line breaks.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.session import cut

#: Letters of other scripts drawn like a Latin letter, and that letter. Letters that only resemble one are left out (α, γ, σ, г, Ь).
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХҮѴԌԚԜӀ": "ABESIJKMHOPCTYXYVGQWl",
    "аеорсухүѕіјһѡԁԛԝѵӏ": "aeopcyxysijhwdqwvl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹϺͿϳ": "ABEZHIKMNOPTYXFCMJj",
    "ονρυϲ": "ovpuc",
    "ՍՏՕզհոսցօ": "USOqhnugo",
    "ɡɑ": "ga",
    "ᎠᎢᎩᎪᎫᎬᎳᎷᎻᏀᏃᏕᏙᏚᏞᏟᏢᏦᏴ": "DTYAJEWMHGZSVSLCPKB",
    "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ": "HIKMNOPCTYXopc",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
}
#: Punctuation drawn alike.
MARKS = {"‐": "-", "‑": "-", "ʼ": "’", "ˈ": "'", "׃": ":", "；": ";", ";": ";", "·": "·", "‧": "·", "・": "・", "〜": "~", "꞉": ":", "∶": ":", "∕": "/"}
#: Compatibility decompositions that do not change what a reader sees.
KINDS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>", "<font>"}
#: Characters that look the same once drawn as another one would be wrong to merge.
APART = ["O0", "Il", "l1", "éе", "eé", "аá", "–-", "—–", "’'", "“\"", "….", "²2", "①1", "½1", "カガ", "カか", "へベ", "一ー", "口ロ", "二ニ", "\n ", "\t ", "ßb", "øo", "ıi", "ŁL", "ñn", "αa", "гr", "−-", "′'"]
#: Invisible code points outside the format category.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u2800"
_VIRAMAS = {c for c in map(chr, range(0x900, 0x1100)) if ud.combining(c) == 9}


class ConflictError(ValueError):
    """The mapping would map a result further or merge characters that must stay apart."""


def _invisible(c: str) -> bool:
    if c in BLANKS or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or 0x180B <= ord(c) <= 0x180F:
        return True
    # numbers signs and the like of the format category are drawn; joiners are judged in context
    return ud.category(c) == "Cf" and not (0x600 <= ord(c) <= 0x605 or ord(c) in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD, 0x200D))


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """Code point to canonical form, for every code point that is not canonical itself."""
    plain = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v, strict=True)}
    plain |= MARKS
    raw: dict[str, str] = {}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        kind = ud.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if _invisible(c):
            raw[c] = ""
        elif kind == "Zs":
            raw[c] = " "
        elif c in "\x85\u2028\u2029":
            raw[c] = "\n"
        elif d := ud.decomposition(c):
            tag, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
            if c != "…" and (not tag or tag in KINDS):
                to = "".join(chr(int(x, 16)) for x in rest.split())
                if not (tag == "<compat>" and to[0] == " " and len(to) > 1):  # spacing accents stay
                    raw[c] = to
    raw |= plain

    def settle(s: str) -> str:
        for _ in range(8):
            t = ud.normalize("NFC", "".join(raw.get(x, x) for x in ud.normalize("NFD", s)))
            if t == s:
                return t
            s = t
        raise ConflictError(f"no fixed point for {s!r}")

    out = {}
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if (c in raw or ud.decomposition(c)[:1] not in ("", "<")) and (r := settle(c)) != c:
            out[c] = r
    check(out)
    return out


def check(mapping: dict[str, str]) -> None:
    """Raise unless results are final, every character keeps the case or value of the letter or digit it
    becomes, and the pairs of :data:`APART` stay apart."""
    for c, to in mapping.items():
        if any(x in mapping and mapping[x] != x for x in to):
            raise ConflictError(f"{c!r} maps to {to!r}, which is mapped further")
    for c, to in mapping.items():
        if len(to) == 1 and to.isascii() and to.isalnum():
            # whatever merges with a Latin letter or digit has its case or value; the palochka is drawn like a small l
            if to.isdigit() and ud.digit(c, -1) != int(to) or c != "Ӏ" and (c.isupper() and to.islower() or c.islower() and to.isupper()):
                raise ConflictError(f"{c!r} would become {to!r}")
    for pair in APART:
        if mapping.get(pair[0], pair[0]) == mapping.get(pair[1], pair[1]):
            raise ConflictError(f"{pair!r} would become the same")


@lru_cache(maxsize=1)
def _machine() -> re.Pattern:
    """One alternation, longest first: line ends, clusters with marks, joiners, mapped code points."""
    # signs that compose with what stands before them count as marks even where their class is that of a letter
    parts = [ud.decomposition(chr(n)).split() for n in range(0x300, sys.maxunicode + 1)]
    signs = {c for x in parts if len(x) == 2 and x[0][0] != "<" and ud.category(c := chr(int(x[1], 16))) in ("Mn", "Mc")}
    marks = _ranges(sorted(signs | {c for c in map(chr, range(0x300, sys.maxunicode + 1)) if ud.category(c) in ("Mn", "Mc") and ud.combining(c)} | {"ﾞ", "ﾟ"}))
    skip = _ranges([c for c, to in table().items() if not to])
    single = _ranges(list(table()))
    hangul = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]"
    return re.compile(f"\r\n?|{hangul}|[^\\s{marks}{skip}][{skip}]*(?:[{marks}][{skip}]*)+|\u200d|[{single}]")


def _ranges(chars: list[str]) -> str:
    """The inside of a regular expression class."""
    out, n = [], sorted(map(ord, chars))
    a = b = n[0]
    for x in [*n[1:], -1]:
        if x == b + 1:
            b = x
            continue
        out.append(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else ""))
        a = b = x
    return "".join(out)


_CLUSTERS: dict[str, str] = {}


def _emit(m: re.Match) -> str:
    s = m[0]
    if s[0] == "\r":
        return "\n"
    if s == "\u200d":  # kept where it shapes what is seen: after a virama and inside emoji
        i = m.start()
        return s if i and (m.string[i - 1] in _VIRAMAS or ud.category(m.string[i - 1]) in ("So", "Sk", "Mn")) else ""
    to = _CLUSTERS.get(s)
    if to is None:
        t = table()
        to = ud.normalize("NFC", "".join(t.get(c, c) for c in s.replace("ﾞ", "゙").replace("ﾟ", "゚")))
        to = ud.normalize("NFC", "".join(t.get(c, c) for c in ud.normalize("NFD", to)))
        if len(_CLUSTERS) < 200_000:
            _CLUSTERS[s] = to
    return to


def canonical(text: str) -> str:
    """``text`` in the one form; applying it twice changes nothing."""
    if text.isascii() and "\r" not in text:
        return text
    return _machine().sub(_emit, text)


def texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``text`` in canonical form; null stays null, empty stays empty. One row out for each row in."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([None if t is None else canonical(t) for t in b.column(len(keys)).to_pylist()], pa.string())
            yield pa.record_batch([*b.columns[: len(keys)], done], names=[*keys, "text"])

    return df.select(*keys, text).mapInArrow(run, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        form, raw = [], []
        for t in b.column(1).to_pylist():
            r = hashlib.blake2b(t.encode(), digest_size=16).digest()
            c = canonical(t)
            raw.append(r)
            form.append(r if c == t else hashlib.blake2b(c.encode(), digest_size=16).digest())
        yield pa.record_batch([b.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["node_no", "form", "raw"])


def pairs(df: DataFrame, key: str = "node_no", text: str = "text") -> DataFrame:
    """``(node_no_a, node_no_b)``: rows whose texts read the same but are different code points,
    smaller number first. Rows delivered twice count once; null and empty texts form no pair.

    Only digests of 16 bytes are shuffled. Forms with a single spelling drop out; the others pair
    their distinct spellings, and each pair of spellings then meets its rows, so copies of one
    spelling are never compared with each other and every row that is joined is a result.
    """
    rows = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("node_no"), text)
    # written once: its uses below prune different columns, and each would run the transducer again
    marked = cut(rows.mapInArrow(_digests, "node_no long, form binary, raw binary").distinct())
    spelling = marked.groupBy("form", "raw").agg(F.lit(1).alias("one"))
    several = spelling.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    some = spelling.join(several, "form", "left_semi")
    ra, rb = (some.select("form", F.col("raw").alias(x)) for x in ("ra", "rb"))
    twins = ra.join(rb, "form").where("ra < rb").select("ra", "rb")
    left = marked.join(several, "form", "left_semi")
    a, b = (left.select(F.col("raw").alias(f"r{x}"), F.col("node_no").alias(f"n{x}")) for x in "ab")
    hit = twins.join(a, "ra").join(b, "rb").where("na <> nb")
    return hit.select(F.least("na", "nb").alias("node_no_a"), F.greatest("na", "nb").alias("node_no_b")).distinct()
