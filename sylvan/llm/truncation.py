"""Text cut off by field limits (problem 4).

Every text's length, finished or not, is recomputed as code points, UTF-8 bytes, UTF-16 units, JSON
escaped, entity escaped and with line ends as CR LF. Lengths at which the texts of a source, or its
unfinished ones, pile up expose its hidden limits. Then endings are inspected: an unfinished one is
a cut; where the ending alone leaves it open (an ellipsis, an abbreviation's stop, a closed
quotation, the end of a possible title), a text is cut if it ends exactly at a limit of its source.
A possible title is cut as well if its last word stands in no other text, so is part of one, while
its other words do; an ending in a script without full stops, if it ends no sentence elsewhere.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.abbreviations import NONE, Language, Speech, every
from sylvan.llm.sentences import folded
from sylvan.session import cut as write

MEASURES = ("chars", "utf8", "utf16", "json", "entities", "crlf")
#: A limit: so many unfinished texts, or texts of any ending, of one length as chance would not bring, against those of
#: near lengths (this many deviations of a Poisson count over the usual, and as many texts more), at every size of the tables.
NEAR, SURE, SURE_OF_ALL = 8, 3.5, 7
#: Length of the endings that are compared where a script has no full stop; an ending of a sentence is one that ends at
#: least this many and this share of all sentences in that script.
TAIL, TAIL_LEAST, TAIL_SHARE = 6, 2, 2e-5
#: Most words of a title.
TITLE = 10

#: What is put in place of the rest, in brackets or words.
_REST = re.compile(
    r"\s*(?:[\[(<{]\s*(?:\.\.\.|…|\.\. ?\.|more|cut|truncated|continued|snip(?:ped)?|abridged|read more|rest omitted|omitted|gekürzt|suite|sigue|続く|省略|以下略)\s*[\])>}]"
    r"|(?:>>+|→|⏎|⋯)|read more|\(cont(?:inued|\.)?\)|<cut>|<snip>|##+more)\s*$",
    re.IGNORECASE,
)
_DOTS = re.compile(r"\s*(?:\.{2,}|…+|‥+)\s*$")
#: Closing marks and notes that may follow a finished text.
_NOTE = re.compile(
    r"\s+(?:\*+|†|‡|#|§|∎|■|◆|\[\s*\d{1,3}\s*\]|\(\s*\d{1,3}\s*/\s*\d{1,3}\s*\)|[—–-]{1,3}\s*(?:END|Ende|FIN|Fin|Fine|конец|КОНЕЦ|完|終|了|終わり)\.?|(?:END|EOF|FIN)|\(?(?:end|fin|sic|edited|ed\.)\)?)$"
)
_STOP = set(".!?。！？｡।॥።፧؟۔։‼⁇⁈⁉")
_CLOSERS = "”’\"'»›」』)]）】》〉“"
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "„": "“"}
_HALF = re.compile(r"(?:&#?[A-Za-z0-9]{0,8}|\\u?[0-9a-fA-F]{0,3}|%[0-9A-Fa-f]?)$")
_HEADING = re.compile(r"^\s*(?:\d+(?:\.\d+)*\.?\s|(?:appendix|chapter|section|part|annex|anhang|kapitel|annexe|chapitre|anexo|capítulo|приложение|глава|παράρτημα|κεφάλαιο)\s+[\dIVXLC]+\b|第\s*[\d一二三四五六七八九十百]+\s*[章节節部回]|บทที่|अध्याय|الفصل|ምዕራፍ)", re.IGNORECASE)
_HEADING_END = re.compile(r"\d\s*[)）\]]?$")
_SEPARATOR = re.compile(r"\s*[,،、，;；፣·|/]\s*|\n+")
_THAI = re.compile("[฀-໿ក-៿က-႟]")
_NOT_DOT = re.compile("[ऀ-෿฀-໿ሀ-᎟぀-ヿ㐀-鿿က-႟ក-៿]")
_CAPS_WORD = re.compile(r"[^\W\d_]+(?:[-’' .][^\W\d_]+)*\.?$")


def measures(text: str) -> list[int]:
    """Lengths of ``text`` in the order of :data:`MEASURES`."""
    unix = text.replace("\r\n", "\n")
    return [
        len(text),
        len(text.encode("utf-8", "surrogatepass")),
        len(text.encode("utf-16-le", "surrogatepass")) // 2,
        len(json.dumps(text)) - 2,
        len(html.escape(text)),
        len(unix) + unix.count("\n"),
    ]


#: Words of scripts with capitals.
_WORD = re.compile("[A-Za-zÀ-ɏͰ-ϿЀ-֏Ḁ-῿]+(?:[-’'][A-Za-zÀ-ɏͰ-ϿЀ-֏Ḁ-῿]+)*")
_CASED = re.compile(r"[^\W\d_]")


def _title(text: str, said: Language) -> list[str]:
    """The words of a line that may be a title, in small letters, else none: few words in a script
    with capitals, the first with one, no comma, no clause, no function word or beginning of one at the end."""
    words = [w.lower() for w in _WORD.findall(text)]
    if not 0 < len(words) <= TITLE or any(c in text for c in "\n,;!?…") or re.search(r"[.:]\s|[^\w)]$", text):
        return []
    first = _CASED.search(text)[0]
    if first.lower() == first or first.upper() == first.lower():
        return []
    last = words[-1]
    if last in said.starters or len(last) < 2 or said.clause.intersection(words):
        return []
    return [] if any(w.startswith(last) for w in said.starters | said.clause) else words


def _is_list(text: str) -> bool:
    """Names only, set apart by commas or line breaks."""
    items = [x for x in _SEPARATOR.split(text.strip()) if x]
    if len(items) < 3:
        return False
    for x in items:
        words = x.split()
        if len(words) > 4 or len(x) > 48 or any(c in _STOP - {"."} for c in x) or not _CAPS_WORD.match(unicodedata.normalize("NFC", x).translate(_MARKS)):
            return False
        if any(w[0].islower() for w in words) and any(c.isupper() or c.islower() for c in x):
            return False
    return True


_MARKS = {n: None for n in range(0x300, 0x1100) if unicodedata.category(chr(n)) in ("Mn", "Mc")} | {0x30FB: None, 0x200B: None, 0x200C: None, 0x2060: None, 0xFEFF: None, 0xAD: None, 0x3099: None, 0x309A: None, 0x30FC: None}


def _unclosed(text: str) -> bool:
    """Whether a bracket or quotation is open at the end."""
    open_: list[str] = []
    for i, c in enumerate(text):
        if c == "“" and open_ and open_[-1] == "“":  # closes a low German quotation
            open_.pop()
        elif open_ and c == open_[-1]:
            open_.pop()
        elif c in _PAIRS and not (c == "“" and i and text[i - 1] in ".!?"):
            open_.append(_PAIRS[c])
    return any(c in "”»」』“）)" for c in open_[-1:])


def _last_sentence_quoted(text: str) -> bool:
    """Whether the text ends with a quotation that began the sentence, so that more may follow."""
    return bool(re.search(r"(?:^|[.!?。！？।።؟][”»“」』)）]*\s*)[“«„「『][^”»」』“]*[.!?。！？।።؟]\s?[”»“」』]$", text))


def ending(text: str) -> tuple[str, str, str]:
    """``(state, rest, tail)``: how a non-empty text ends.

    'done': finished; 'open': unfinished; 'marked': something stands in place of the rest; 'dots':
    ends in an ellipsis; 'maybe': finished unless it is at a limit; 'tail': its script has no full
    stop, so its ``tail`` must be known to end sentences; 'title': may be a title, whose words are
    the ``tail``. ``rest`` is the text whose length counts
    against a limit.
    """
    body = text.rstrip()
    if not body:
        return "done", text, ""
    if m := _REST.search(body):
        return "marked", body[: m.start()] if m.start() else body, ""
    if body[-1] == "�":
        return "open", body, ""
    f = folded(body)[0].rstrip()
    g = f
    while m := _NOTE.search(g):
        g = g[: m.start()].rstrip()
    while g and (unicodedata.category(g[-1]) in ("So", "Sk") or g[-1] in "‍️"):
        g = g[:-1].rstrip()
    noted = g != f
    if not g:
        return "done", body, ""
    if m := _DOTS.search(g):
        return ("open" if m.start() == 0 else "dots"), body[: len(body) - len(g) + m.start()] if not noted else g[: m.start()], ""
    core = g.rstrip(_CLOSERS + " ")
    closed = g[len(core) :].strip()
    last = core[-1:] or " "
    heading = _HEADING.match(g) is not None
    if last in _STOP or (last in ";;" and re.search("[Ͱ-Ͽ]", body[-20:])):
        if _unclosed(g):
            return "open", body, ""
        if last == "." and not closed:
            raw = re.search(r"[^\s“”„«»‚‘(（「」『』)）!?…,;:]*$", core[:-1])[0]
            token = raw.lower()
            if _NOT_DOT.search(core[-6:-1]) or (core[-2:-1].isdigit() and _NOT_DOT.search(core[-16:-1])):
                if not re.search(r"\s[A-Za-z]+\.$", core):
                    return "open", body, ""
            said = _speaker(core, len(core) - 1 - len(raw)) if token in every() else NONE
            short = token in said.never or token in said.numbered
            if short or (len(raw) == 1 and raw.isalpha()) or re.fullmatch(r"v\d+(\.\d+)*", token):
                return "open" if not (heading or token in said.maybe or short and token in said.words) else "maybe", body, ""
            if token in said.maybe or (token.isdigit() and len(token) <= 3):
                return "maybe", body, ""
            return "done", body, ""
        if closed and not noted and _last_sentence_quoted(g):
            return "maybe", body, ""
        return "done", body, ""
    if _unclosed(g):
        return "open", body, ""
    if _HALF.search(core) and not closed and core[-1] in "\\%&":
        return "open", body, ""
    if heading and _HEADING_END.search(g):
        return "done", body, ""
    if _is_list(g):
        return "done", body, ""
    if _THAI.search(g[-8:]) and not heading:
        if g[-1] in "เแโใไ":  # a vowel written before its consonant
            return "open", body, ""
        return "tail", body, g[-TAIL:]
    if heading and re.match(r"^\s*บทที่", g) and g[-1].isdigit():
        return "done", body, ""
    if len(g) < 200 and not noted and (words := _title(g.strip(), _speaker(g, len(g)))):
        return "title", body, " ".join(words)
    return "open", body, ""


def _speaker(text: str, at: int) -> Language:
    """The language of a folded text's last paragraph, for the token that begins at ``at``."""
    a = text.rfind("\n\n") + 2 if "\n\n" in text else 0
    return Speech(text).of(a, len(text), at, len(text))


def _tails(text: str) -> list[str]:
    """Ends of the inner sentences of a text in a script that sets them apart by spaces only."""
    f = folded(text)[0]
    return [m[1][-TAIL:] for m in re.finditer(r"(\S+)\s+(?=\S)", f) if _THAI.match(m[1][-1]) and len(m[1]) > TAIL]


_MARKED = "id string, source string, text_hash long, state string, tail string, lengths array<int>, known array<string>, words array<struct<word: string, low: long, high: long>>"
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("low", pa.int64()), ("high", pa.int64())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and for each batch one with a null id that holds its words, each with the
    least and greatest hash of the texts it stands in, a text's last word left out."""
    for b in batches:
        states, tails, lengths, known, hashes = [], [], [], [], []
        words: dict[str, tuple[int, int]] = {}
        for t in b.column(2).to_pylist():
            h = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            state, rest, tail = ending(t)
            hashes.append(h)
            states.append(state)
            tails.append(tail)
            lengths.append(measures(rest))
            known.append(_tails(t) if _THAI.search(t) else [])
            found_ = _WORD.findall(t if t.isascii() or not _WORD.search(t) else folded(t)[0])
            inner = set(map(str.lower, found_[:-1]))
            if state == "title":
                inner |= set(tail.split(" ")[:-1])
            for w in inner:
                low, high = words.get(w, (h, h))
                words[w] = (min(low, h), max(high, h))
        n = len(states)
        told = [None] * n + [[{"word": w, "low": a, "high": z} for w, (a, z) in words.items()]]
        cols = [pa.concat_arrays([b.column(k), pa.nulls(1, pa.string())]) for k in (0, 1)]
        more = [pa.array([*x, None], kind) for x, kind in ((hashes, pa.int64()), (states, pa.string()), (tails, pa.string()), (lengths, pa.list_(pa.int32())), (known, pa.list_(pa.string())))]
        yield pa.record_batch([*cols, *more, pa.array(told, _WORDS)], names=["id", "source", "text_hash", "state", "tail", "lengths", "known", "words"])


def _marked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct id, source and text with its ending and lengths, numbered by ``k``; and the
    words. Texts are read once and not shuffled; rows delivered twice drop out by their hashes."""
    rows = nodes.where(F.col("id").isNotNull() & (F.length("text") > 0)).select("id", F.coalesce("source", F.lit("")).alias("source"), "text")
    raw = write(rows.mapInArrow(_judge, _MARKED))
    each = raw.where("id is not null").drop("words").dropDuplicates(["id", "source", "text_hash"])
    return each.withColumn("k", F.xxhash64("id", "source", "text_hash")), raw.where("words is not null").select(F.explode("words").alias("w")).select("w.*")


def _titles(marked: DataFrame, words: DataFrame) -> DataFrame:
    """``(k, part)`` of each possible title; ``part``: its last word stands in no other text, though
    at least two of its others do, more than not."""
    own = marked.where("state = 'title'").select("k", "text_hash", F.posexplode(F.reverse(F.split("tail", " "))).alias("at", "word"))
    seen = words.groupBy("word").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    other = own.join(seen, "word", "left").select("k", "at", F.coalesce((F.col("low") != F.col("text_hash")) | (F.col("high") != F.col("text_hash")), F.lit(False)).alias("other"))
    n = other.groupBy("k").agg(
        F.max(F.when(F.col("at") == 0, F.col("other"))).alias("last"), F.sum(F.when(F.col("at") > 0, F.col("other").cast("int")).otherwise(0)).alias("n"), F.count("*").alias("all")
    )
    return n.select("k", (~F.col("last") & (F.col("n") >= 2) & (F.col("n") * 2 >= F.col("all") - 1)).alias("part"))


def _lengths(marked: DataFrame) -> DataFrame:
    return marked.select("k", "source", "state", F.posexplode("lengths").alias("measure", "length"))


def judged(nodes: DataFrame) -> DataFrame:
    """``(id, source, cut, at)`` for each distinct id, source and text that is not null or empty:
    whether the text is cut off, and the measure of the source's limit it ends at (null if none)."""
    marked, words = _marked(nodes)
    marked = write(marked)
    long = _lengths(marked)
    at = long.join(limits_of(long).select("source", "measure", "length"), ["source", "measure", "length"], "left_semi").groupBy("k").agg(F.min("measure").alias("measure"))
    ends = marked.select(F.explode("known").alias("tail")).groupBy("tail").agg(F.count("*").alias("n"))
    total = ends.agg(F.sum("n")).first()[0] or 0
    ends = ends.where(F.col("n") >= max(TAIL_LEAST, TAIL_SHARE * total)).select("tail", F.lit(True).alias("ends"))
    all_ = marked.select("k", "id", "source", "state", "tail").join(at, "k", "left").join(ends, "tail", "left").join(_titles(marked, words), "k", "left")
    # where most such texts end as sentences elsewhere do, the others are cut; a sparse table does not tell
    tails = all_.where("state = 'tail'").agg(F.count("ends").alias("known"), F.count("*").alias("n")).first()
    told = F.lit(tails["known"] * 2 >= tails["n"])
    names = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1)
    at_limit = F.col("measure").isNotNull()
    is_cut = (
        F.when(F.col("state").isin("open", "marked"), True)
        .when(F.col("state").isin("dots", "maybe"), at_limit)
        .when(F.col("state") == "tail", F.col("ends").isNull() & (told | at_limit))
        .when(F.col("state") == "title", at_limit | F.coalesce("part", F.lit(False)))
        .otherwise(False)
    )
    return all_.select("id", "source", is_cut.alias("cut"), F.when(at_limit, names).alias("at"))


def limits_of(lengths: DataFrame) -> DataFrame:
    """``(source, measure, length, texts, unfinished)`` at which texts pile up, all of them or the
    unfinished, against the average within :data:`NEAR` lengths on either side."""
    open_ = F.col("state").isin("open", "marked", "dots").cast("long")
    count = lengths.groupBy("source", "measure", "length").agg(F.count("*").alias("texts"), F.sum(open_).alias("unfinished"))
    shift = F.explode(F.array(*[F.lit(x) for x in range(-NEAR, NEAR + 1) if x])).alias("shift")
    near = count.select("*", shift).select("source", "measure", (F.col("length") + F.col("shift")).alias("length"), "texts", "unfinished")
    near = near.groupBy("source", "measure", "length").agg(F.sum("texts").alias("t"), F.sum("unfinished").alias("u"))
    both = count.join(near, ["source", "measure", "length"], "left").na.fill(0, ["t", "u"])

    def usual(around: str) -> Column:
        return 0.25 + F.col(around) / (2 * NEAR)

    def piled(n: str, around: str, sure: float) -> Column:
        return F.col(n) >= usual(around) + sure * (F.sqrt(usual(around)) + 1)

    return both.where(piled("unfinished", "u", SURE) | piled("texts", "t", SURE_OF_ALL)).select("source", "measure", "length", "texts", "unfinished")


def found(nodes: DataFrame) -> DataFrame:
    """``(node_id)``: each id whose text is cut off. Null and empty texts are not; a null source is
    a source of its own."""
    return judged(nodes).where("cut").select(F.col("id").alias("node_id")).distinct()


def rates(nodes: DataFrame) -> DataFrame:
    """``source, texts, cut, share``: how often each source truncates, over distinct ids."""
    one = judged(nodes).groupBy("source", "id").agg(F.max("cut").alias("cut"))
    n = one.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return n.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))


def limits(nodes: DataFrame) -> DataFrame:
    """``source, measure, length, texts, unfinished``: the hidden limits of each source."""
    found_ = limits_of(_lengths(_marked(nodes)[0]))
    return found_.withColumn("measure", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1))
