"""Sentence boundaries across languages and scripts (problem 3).

The rules follow the Unicode sentence-break properties: a run of terminators of any script, the
closing marks after it, then what follows decides. On top of them stand abbreviation suppression
for each language, decimals, ordinals, initials, and the handling of quotations: one with words
of its sentence around it stays inside that sentence. The language is read from the text itself
(see :mod:`sylvan.llm.abbreviations`), since declared languages are often missing or wrong.

Rules look at a folded copy (invisible characters dropped, width forms and look-alike letters
brought together); positions are those of the text as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import lookalike
from sylvan.llm.abbreviations import NONE, Language, Speech, every

def _having(prop: str) -> str:
    """All characters with a Unicode property; none of those used here lies beyond plane 1."""
    return "".join(regex.findall(prop, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))))


#: Sentence terminators of all scripts by their properties; ellipses end as well where their sentence does, the semicolon in Greek.
_TERM = re.compile("[" + re.escape(_having(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}\p{Sentence_Terminal}]")) + "…‥;]+")
_WIDE = set("。！？｡")
_PLAIN_WIDE, _PLAIN = frozenset("。！？"), frozenset("!?")
_CLOSE = re.compile("(?:[ ]?[»›](?!\\w)|[»›]|[”’\"'" + re.escape(_having(r"\p{Pe}")) + "]|“(?!\\w))*")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\u2029")
_TOKEN = re.compile(r"[^\s“”„«»‚‘()（）「」『』\[\]—–!?…,;:。！？、，\u3040-\u30ff\u3400-\u9fff]*$")
_DASH = re.compile(r"[—–―-]\s*(.?)")
_LONG = re.compile(r"[0-9A-Za-z+/=_-]{40}")
_SPACE = re.compile(r"\s+")
_THAI = re.compile("[฀-๿຀-໿]")
#: What makes the next word the number of a figure, page or law.
_NUMBER = re.compile(r"[#№(\[]?(?:\d|[IVXLCDM]+\b|[A-Z]\b)")
_WORD = re.compile(r"\w+")
_PARTICLES = set("とっなのはがをにでもやへてだよねかさわ")
#: Verbs of saying that follow a quotation of their own sentence, by their first character.
_SAYING = set("言話語述答問聞呼叫曰說说道喊问")
_QUOTES = set("”’\"'»›」』｣“")
_OPEN = set("“„«‹「『（([{¿¡‚‘〈《【｢\"'")
_BRACKETS = set(")）]】》〉}")


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """A coarse class of a character: latin-like (cased), digit, or a caseless script's name."""
    n = ord(c)
    if c.isdigit():
        return "digit"
    if 0x3040 <= n <= 0x30FF or 0x31F0 <= n <= 0x31FF or 0xFF66 <= n <= 0xFF9F:
        return "kana"
    if 0x2E80 <= n <= 0x2FDF or 0x3400 <= n <= 0x9FFF or 0xF900 <= n <= 0xFAFF or 0x20000 <= n <= 0x3FFFF or n in (0x3005, 0x3007):
        return "han"
    if 0xE00 <= n <= 0xEFF:
        return "thai"
    if 0x590 <= n <= 0x8FF or 0xFB1D <= n <= 0xFDFF or 0xFE70 <= n <= 0xFEFE:
        return "arabic"
    if 0x900 <= n <= 0xDFF or 0x1200 <= n <= 0x139F:
        return "indic"
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "greek"
    if c.isalpha():
        return "cased" if c.upper() != c.lower() else "other"
    return "mark"


@lru_cache(maxsize=1)
def _folding() -> tuple[dict[int, str], re.Pattern]:
    """One-to-one folds, and the pattern of characters that are dropped."""
    t = lookalike.table()
    keep = set(map(chr, [*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFFA0)])) | {";"}
    one = {ord(c): to for c, to in t.items() if len(to) == 1 and to != "\n" and c not in keep}
    one |= {0x85: "\n", 0x2028: "\n", 0x37E: ";", 0xFF0E: "."}
    return one, re.compile("[" + lookalike._ranges([c for c, to in t.items() if not to] + ["\u200d"]) + "]")


def folded(text: str) -> tuple[str, str, list[int] | None]:
    """The folded copy, the given characters beside it, and their positions (None: the same)."""
    if text.isascii():
        f = text if "\r" not in text else text.replace("\r\n", " \n").replace("\r", "\n")
        return f, text, None
    one, drop = _folding()
    pos = None
    o = text
    if drop.search(text):
        o = drop.sub("", text)
        gaps = [0, *(i for m in drop.finditer(text) for i in m.span()), len(text)]
        pos = [i for a, b in zip(gaps[::2], gaps[1::2], strict=True) for i in range(a, b)]
    return o.replace("\r\n", " \n").replace("\r", "\n").translate(one), o, pos


def _ends(f: str, o: str, a: int, b: int, m: re.Match, speech: Speech, begin: int) -> int:
    """Where the sentence that began at ``begin`` ends if it does at the terminators ``m`` of the paragraph ``[a, b)``, else -1."""
    s, e = m.span()
    term = f[s:e]
    # most places need no rules: a full-width mark before a kana or ideograph, a mark before a blank and a capital
    if term in _PLAIN_WIDE and e < b and "\u3040" <= f[e] <= "\u9fff" or term in _PLAIN and e + 1 < b and f[e] == " " and "A" <= f[e + 1] <= "Z":
        return e
    close = _CLOSE.match(f, e, b)
    end = close.end()
    closers = f[e:end]
    if end >= b:
        return b
    k = end
    while k < b and f[k].isspace():
        k += 1
    if k >= b:
        return end
    spaced = k > end
    c = f[k]
    kind = _script(o[k])
    prev = o[s - 1] if s > a else " "
    quoted = any(x in _QUOTES for x in closers)
    cased = kind in ("cased", "greek")
    junk = spaced and _LONG.match(f, k) is not None
    camel = cased and c.islower() and k + 1 < b and f[k + 1].isupper()
    lower = cased and c.islower() and not camel and not junk
    if c in ",;:、，；：)）]】»›」』":
        return -1
    dash = _DASH.match(f, k, b)
    if dash and (spaced or quoted):
        d = dash[1]
        if d and d not in "¿¡«“„\"" and not d.isupper():
            return -1
        if not spaced:
            return -1
    if ";" in term:
        # a question mark only in Greek
        if term != ";" or not any(_script(x) == "greek" for x in o[max(a, s - 12) : s] if x.isalpha()):
            return -1
        return end if (spaced or cased and c.isupper()) and not lower else -1
    if any(x in _WIDE for x in term):
        if lower and not term.count("。"):
            return -1
        if closers and not spaced:
            if closers[-1] in _BRACKETS and (kind in ("kana", "han") or cased):
                return -1
            if quoted:
                if c in "「『“（":
                    return end
                if kind == "kana":
                    return -1 if c in _PARTICLES or closers[-1] not in "」』" else end
                if kind == "han":
                    return -1 if closers[-1] not in "」』" or c in _SAYING else end
        if quoted and spaced and c in "とっ" and f[k : k + 2] in ("とい", "と言", "って", "とは"):
            return -1
        return end
    if set(term) <= set("…‥.") and (len(term) > 1 or term in "…‥"):
        if not spaced and not closers:
            return -1
        if lower or kind in ("kana", "han") and not spaced:
            return -1
        if quoted and kind in ("arabic", "indic", "thai"):
            return -1
        return end if spaced or (cased and c.isupper()) or c in _OPEN else -1
    if term[-1] == "." and len(term) == 1:
        if not closers:
            token = _TOKEN.search(f, max(begin, s - 40), s)[0].lstrip("'\"’([¿¡-*").lower()
            raw = _TOKEN.search(f, max(begin, s - 40), s)[0]
            pk = _script(prev)
            said = speech.of(a, b, s - len(token), s) if token in every() or token.isdigit() and len(token) <= 2 else NONE
            maybe, months = said.maybe, said.months
            if pk == "thai":
                return -1
            if (token in said.never or token in said.numbered) and not _goes_on(f, k, b, token, said, spaced):
                return end
            if token in said.never or token in said.numbered:
                return -1
            if pk == "indic" and not spaced:
                return -1
            if not spaced:
                if kind == "digit" or lower or kind == "mark" and c not in _OPEN:
                    return -1
                if c in _OPEN:
                    return end if len(token) > 1 and token not in maybe else -1
                if "/" in token or "@" in token or not (prev.isalnum() or prev in "%°$€)）"):
                    return -1
                if pk == "digit":
                    return end if cased and c.isupper() and k + 1 < b and f[k + 1].islower() and token.rstrip("0123456789.,") == "" else -1
                if cased:
                    good = c.isupper() or camel
                    after = f[k + 1] if k + 1 < b else " "
                    return end if good and ("." not in token or token in maybe) and len(token) > 1 and (after.islower() or after in " .’'°" or camel or not after.isalpha()) and (prev.islower() or token in maybe or not prev.isalpha()) else -1
                return end if kind == pk and len(token) > 1 else -1
            if raw and len(raw) == 1 and raw.isupper() and pk not in ("digit",):
                return -1 if (cased and c.isupper()) or lower else end
            if "." in raw and all(len(x) == 1 for x in raw.split(".")) and raw.replace(".", "").isalpha() and token not in maybe:
                return -1
            if lower:
                return -1
            if token in maybe:
                return end if (cased and (c.isupper() or camel)) or c in _OPEN or junk or kind not in ("cased", "greek", "digit", "mark") else -1
            if token.isdigit() and len(token) <= 2 and cased:
                word = re.match(r"\w+", f[k : k + 12])
                if word and word[0].lower() in months:
                    return -1
            return end
        if lower:
            return -1
        if quoted and kind in ("arabic", "indic", "thai"):
            return -1
        if not spaced:
            return end if c in _OPEN or cased and c.isupper() else -1
        return end
    # ! ? and the terminators of other scripts
    if lower:
        return -1
    if quoted and kind in ("arabic", "indic", "thai", "other", "kana", "han"):
        return -1 if not (kind in ("kana", "han") and spaced) else end
    if not spaced:
        if kind == "digit" and term[-1] in "!?":
            return end if closers else -1
        if cased:
            return end if c.isupper() or camel else -1
        if kind == "mark":
            return end if c in _OPEN else -1
    return end


def _goes_on(f: str, k: int, b: int, token: str, said: Language, spaced: bool) -> bool:
    """Whether the sentence goes on at ``k`` after an abbreviation. One that stands before numbers
    does so before one or before a small letter; one that is also a word does not before a capital
    that begins a function word, and if it stands before numbers, before no other capital either."""
    word = _WORD.match(f, k, b)
    if not spaced or not word or not word[0][0].isupper():
        return True
    if token in said.numbered:
        return _NUMBER.match(f, k, b) is not None or token not in said.words and word[0].lower() not in said.starters
    return token not in said.words or word[0].lower() not in said.starters


def _cuts(f: str, o: str, a: int, b: int, speech: Speech) -> list[int]:
    """Ends of the sentences of one paragraph, the last one ``b``."""
    cuts = []
    at = a
    while m := _TERM.search(f, at, b):
        end = _ends(f, o, a, b, m, speech, cuts[-1] if cuts else a)
        at = m.end()
        if end >= 0:
            at = max(at, end)
            cuts.append(end)
    if _THAI.search(o, a, b):
        for m in _SPACE.finditer(f, a, b):
            if a < m.start() and m.end() < b:
                p, n = o[m.start() - 1], o[m.end()]
                if (_THAI.match(p) or _THAI.match(n)) and p not in ",;:、" and n not in ",;:)":
                    cuts.append(m.start())
        cuts = sorted(set(cuts))
    if not cuts or cuts[-1] < b:
        cuts.append(b)
    return cuts


def sentences(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence in order, without white space or byte-order marks around it."""
    f, o, pos = folded(text)
    speech = Speech(f)
    out = []
    blanks = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(f)]
    a = 0
    for s, e in [*blanks, (len(f), len(f))]:
        if s > a:
            begin = a
            for cut in _cuts(f, o, a, s, speech):
                x, y = begin, cut
                begin = cut
                if pos is not None:
                    x, y = pos[x], (pos[y - 1] + 1 if y > x else pos[x])
                    # dropped characters after the last kept one stay with the sentence if it ends a line of text
                while x < y and (text[x].isspace() or text[x] == "\ufeff"):
                    x += 1
                while y > x and (text[y - 1].isspace() or text[y - 1] == "\ufeff"):
                    y -= 1
                if y > x:
                    out.append((x, y))
        a = e
    return out


def split(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """``key, pos, start_idx, end_idx[, sentence]`` of every sentence of every non-null text.

    Rows delivered twice give their sentences twice, for the caller to make distinct; a blank or empty text and a null key give
    no rows. One pass, no shuffle; a text is held by one task, as its row is.
    """
    fields = f"{key} long, pos int, start_idx int, end_idx int" + (", sentence string" if with_text else "")
    names = [key, "pos", "start_idx", "end_idx"] + (["sentence"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, starts, ends, out = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (s, e) in enumerate(sentences(t)):
                    ids.append(i)
                    at.append(n)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        out.append(t[s:e])
            cols = [pa.array(ids, pa.int64()), *(pa.array(np.array(x, np.int32)) for x in (at, starts, ends))]
            yield pa.record_batch(cols + ([pa.array(out, pa.string())] if with_text else []), names=names)

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, fields)
