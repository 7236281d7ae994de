"""Per-document text quality statistics, and natural prose told apart (problem 9).

A document is cut into segments: consecutive lines of one shape (plain, comment of one marker,
bullet, table row, inside a block comment). Statistics of a segment, standardized, are explained by
a Gaussian mixture fitted by expectation-maximization; each component is then mapped to prose,
code, list, table or junk by the inspected examples below that it explains best. A document's share
of prose is the share of its characters, without white space, in prose segments.

Texts are read and measured once; the statistics of their segments, some 50 bytes each, are written
beside the counts of their document. Mean and scale, and each round of expectation-maximization,
are then sums over all segments of all documents, added up per task and in one aggregation. Only the
place where the rounds begin comes from a bounded sample (``SEED_DOCUMENTS``, ``SEED_SEGMENTS``),
the documents of the smallest hashes of their ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log1p, sqrt
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.session import cut

SEED_DOCUMENTS, SEED_SEGMENTS = 1_500, 6_000
COMPONENTS, SEED_ROUNDS, SEED = 20, 40, 11
#: Rounds over all segments; they end before if the mean log likelihood gains less than this.
ROUNDS, GAIN = 12, 1e-3
#: Sums are added up as whole multiples of this, so that their order does not matter.
GRAIN = 2.0**-20
#: Weight of all inspected examples against all fitted segments.
ANCHOR = 0.2
#: Inspected examples that name a component.
NEIGHBOURS = 3
#: The word length given to text in scripts without spaces.
CJK_LENGTH = 4.0
CLASSES = ("prose", "code", "list", "table", "junk")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARK = re.compile(r"^\s*(#+!?|//[/!]?|--+|;+|%+|\*+(?=\s|$)|/\*+|<!--|\"\"\"|'''|>+|\.\.|[-+•](?=\s)|\d+[.)](?=\s)|=+(?=\s)|\|)")
_CLOSE = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
#: Characters that carry the grammar of Japanese and Chinese sentences.
_GLUE = re.compile("[ぁ-ゟ的了在是不把被吗呢和也就很都与及于到说没]")
_CODE = re.compile(r"[{}\[\]()<>=;_|\\/&^~$@#*+`]")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？]")
_DIGITS = re.compile(r"\d+")

#: Inspected examples: segments of each class, as they look in repositories.
EXAMPLES = {
    "prose": [
        "The authors give you the right to use and share this work, as long as the notice stays with it.",
        "If the cache stops after many jobs, then it is safe to restart the loader by hand.",
        "Please read the notes on the parser before you change the index. We wrote it because nothing else was stable, and nobody could maintain the old one.",
        "Why does the scheduler call the queue twice?",
        "By default the tool waits for 4000 ms, which is more than most users want.",
        "This is not a goal of the project. It has been tested on a machine with 8 cores and less memory than you have!",
        "Der Motor war lange Zeit stabil, und die Brücke muss sofort geprüft werden! Nach dem Umbau blieb das Ventil rostig.",
        "Ist die Pumpe wirklich defekt? Für den Hafen wurden viele Läufe verglichen, und der Sensor wirkte warm.",
        "La pompe semblait étanche. Pourquoi le moteur est-il hors d’usage ? Le pont a été déplacé après l’essai.",
        "La oficina cita juntas, tornillos, etc., sin fecha. ¿Por qué el sensor sigue frágil? Según el informe, la turbina parecía estable.",
        "По словам инженера, мост снова готов к ремонту. Почему насос в районе станции до сих пор изношен?",
        "担当者は古い記録を何度も調べた。試験のあと観測装置は安定している。もし発電機が熱いなら、どうするのだろうか？",
        "工程师把水泵检查了很多次；结果很稳定。据报告，冷却管需要更换。发电机真的很安静吗？",
        "水泵运行了7025天。宽度为82.6毫米（见手册第9.7节）。工程师在工地把备用电机检查了1905次；结果难以维修。",
        "“旧档案非常安静。”他说。桥墩又停了！记录写着传感器需要更换……然后中断了。",
        "ここでは発電機が4499日間動いた。彼は「本当に熱いのですか？」と357回たずねた。炉の幅は130.5ミリで、基準（第19.7版。）を満たす。",
        "1972年に職員が冷却管を調べたところ、データは扱いにくいという結果になった。急げ！",
        "В 1969 г. инженер проверил рис. 9 и табл. 8. Мост у станции был исправен 3220 дней. Завод указал 58,66 мм для узла 541.",
        "Der Motor war 13097 Tage lang stabil. Nr. 5 wiegt ca. 58,66 kg, berichtet Prof. Haas. Am 9. Mai maß Dr. Haas genau 4,2 mm.",
        "The clerk walks 8685 steps from the gate until dusk, and a guard stores 400 lamps in the shed. How many remain?",
        "This copyright notice (c) 2014 applies to all parts. See sec. 24.6 (p. 6) if the layer is not optional.",
        "Le pont est resté étanche pendant 4313 jours. Voir p. ex. la fig. 24, p. 25, du rapport.",
    ],
    "code": [
        "def load(queue, limit=None):\n    rows = []\n    for row in queue:\n        if row is None or row == 3:\n            continue\n        rows.append(row[2:])\n    return rows or limit",
        "static int probe(struct table *p, size_t n)\n{\n\tfor (size_t i = 0; i < n; i++) {\n\t\tif (p[i].flag & 0x40u)\n\t\t\treturn -1;\n\t}\n\treturn 0;\n}",
        "export const read = async ({ page, size }) => {\n  const res = await page.fetch(`/v2/${size}`);\n  return res.ok ? res.json() : null;\n};",
        "import java.util.List;\nimport java.util.Map;",
        "SELECT a.kind, COUNT(*) AS n\nFROM orders a JOIN parts z ON z.id = a.part_id\nWHERE a.size > 12 AND z.kind = 'small'\nGROUP BY a.kind;",
        "<div class=\"box\" id=\"row-7\">\n  <a href=\"/next?p=4\">go on</a>\n</div>",
        ".header > .row {\n  margin: 0 4px;\n  color: #a40;\n}",
        "if [ \"$LIMIT\" -gt 12 ]; then\n  sort -u > \"/tmp/list.txt\"\nfi",
        "/* index buffer */",
        "import os\nimport sys\nimport logging",
        "static const int t[] = {\n\t0x3146, 0x84d6, 0x8610, 0xf847, 0x9e58,\n\t0x1b94, 0x7aee, 0x8dae, 0x1d2a, 0x2e2b,\n};",
        "message Row {\n  repeated int32 item_1 = 1;\n  optional string name_2 = 2;\n}",
        "function id(i,e){return i&&e[11]?i.check(d>>>2):void 0}var d={i:!0,check:724};function wn(w,e){return w&&e[15]?w.check(n>>>2):void 0}",
        "{\n  \"version\": 2,\n  \"packages\": {\n    \"alpha\": {\"version\": \"2.18.8\", \"integrity\": \"x5-Xqinwy682bvrqhz5cQd\"},",
        "use std::fmt;\n\npub fn get(v: &[u8], n: usize) -> Option<usize> {\n    match v.get(n..) {\n        Some(s) => Some(s.len()),\n        None => None,\n    }\n}",
    ],
    "list": [
        "[ ] rotate Alpha session\n[x] sample Beta offset\n[ ] load Gamma index\n[x] merge Delta route",
        "Added: index merge (#408)\nFixed: queue load (#2610)\nRemoved: token flush (#8707)\nChanged: frame read (#93)",
        "msg.queue.load = Start\nmsg.index.merge = Stop\nmsg.frame.read = Go on",
        "version: 2\nqueue:\n  size: 12\n  names:\n    - alpha route\n    - beta_index",
        "Quality",
        "Getting started",
        "Chapter one\nChapter two\nChapter three",
        "Alpha route;\nBeta config.\nGamma cursor.\nDelta session;\nEta queue.",
        "Theta window.",
        "Iota frame;",
    ],
    "table": [
        "1482,28.906,6182\n8028,56.865,7764\n2601,13.854,3404",
        "Alpha\t1477\tBeta\t10.063\tGamma\n8997\tDelta\t8577\t63.800\tEta",
        "Alpha | 2152 | Beta | Gamma | 9583 | route is optional |\n|---|---|---|---|---|---|\n| Delta | 9080 | Eta | Theta | 6755 | index is fast",
        "offset is optional  87.233          route is fast\nledger is new       69.708          packet is optional",
        "2024-10-23T16:29 [WARN] validate Alpha rc=90\n2024-02-05T20:03 [INFO] load Beta rc=25",
        "00000060  d5 79 2e 68 b3 d6 91 cb cb 49 bf b4 06 01 af af\n00000070  98 c5 b1 28 3a d6 34 1b c4 ed 2a af 80 b0 a6 dd",
    ],
    "junk": [
        "batch that be batch header window be in batch token as token as buffer shard is\nwith this as window buffer header for for shard is batch config shard route for",
        "Alpha Alpha Alpha\nAlpha Alpha Alpha\nAlpha Alpha Alpha",
        "=============================\n-----------------\n***********************",
        "MlKMJ6khjXtVp9E2zZT4jiBa9RfFQlxCDFqbKFKUEQgGaRMgY6lTE8T/5f/FVUGbzOLJPWLDeiun\nxMkhQMn1HRG7J0DFn9FzhWeRaktb57l3zVTvYjn/dSxTUTAY9BBibRK7rGXhZ/SGk82PTk9ltEsX",
        "of and the index to in of be token is frame with on it as queue by at window from",
        "lorem zanta biro kell vanu tiro pesk mona rilo danta sero kulo",
    ],
}


def segments(text: str) -> Iterator[list[str]]:
    """Lines of each segment, without comment markers: consecutive lines of one shape."""
    held: list[str] = []
    shape: object = None
    inside = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        body = line.strip()
        if not body:
            if held:
                yield held
                held, shape = [], None
            continue
        m = _MARK.match(line)
        mark = m[1] if m else ""
        if inside:
            kind: object = "block"
            if inside in body:
                body = body[: body.rindex(inside)]
                inside = ""
            elif mark.startswith("*"):
                body = body[len(mark) :]
        elif mark and (mark.startswith("/*") or mark in ("<!--", '"""', "'''")):
            kind = "block"
            body = body[len(mark) :]
            end = {"/": "*/", "<": "-->"}.get(mark[0], mark)
            if end in body:
                body = body[: body.rindex(end)]
            else:
                inside = end
        elif mark == "|" or "\t" in body or "   " in body or body.count("|") > 1 or (body.count(",") > 2 and ", " not in body):
            kind = "row"
        elif mark:
            kind = mark[0]
            body = body[len(mark) :]
        elif body.startswith("```") or body.startswith("~~~"):
            kind = "fence"
        else:
            kind = "plain"
        body = body.strip()
        if kind != shape and held:
            yield held
            held = []
        shape = kind
        if body:
            held.append(body)
    if held:
        yield held


FEATURES = ("running", "glue", "code", "symbols", "digits", "word_length", "stops", "lower", "repeats", "line_words", "short")


def measure(lines: list[str], common: frozenset[str]) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """Counts of a segment (characters without white space, words, letters, digits, common words)
    and its statistics."""
    text = " ".join(lines)
    size = len(text) - text.count(" ") - text.count("\t")
    if size <= 0:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    words = _WORD.findall(text)
    n = len(words)
    low = list(map(str.lower, words))
    letters = sum(map(len, words))
    digits = sum(map(len, _DIGITS.findall(text)))
    known = sum(map(common.__contains__, low))
    cjk = len(_CJK.findall(text)) if not text.isascii() else 0
    code = len(_CODE.findall(text))
    stops = 0
    last = 0
    for m in _STOP.finditer(text):
        stops += 1
        last = m.end()
    if cjk * 3 > letters:
        glue = min(1.0, 2.5 * len(_GLUE.findall(text)) / max(1, cjk))
        units = cjk / 2.0
        mean = CJK_LENGTH
        lower = 0.8
        repeats = 0.0
    else:
        glue = known / max(1, n)
        units = float(n)
        mean = letters / max(1, n)
        lower = sum(map(eq, words, low)) / max(1, n)
        repeats = max(0.0, 1 - len(set(low)) / min(n, 4 * sqrt(n))) if n else 0.0
    running = last / len(text) if stops and units >= 4 * min(stops, 3) and code / size < 0.06 and glue > 0.04 else 0.0
    return (size, n, letters, digits, known), [
        running, min(glue, 0.6), min(1.0, code / size * 4), (size - letters - digits) / size, digits / size, min(mean, 14.0),
        min(0.5, stops / max(1.0, units) * 2), lower, repeats, log1p(units / len(lines)), 1.0 / (1.0 + units),
    ]


def _squares(z: np.ndarray) -> np.ndarray:
    """One, the statistics and their products by pairs: what a Gaussian's logarithm is linear in."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)


class Mixture:
    """Gaussian mixture on standardized statistics, full covariances."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale

    def start(self, known: np.ndarray, label: np.ndarray, x: np.ndarray) -> Mixture:
        """Components at the inspected examples ``known``, one for each class, and at far points of
        the sample ``x``, then brought near by rounds on the sample."""
        z = np.concatenate([(known - self.mean) / self.scale, (x - self.mean) / self.scale])
        rng = np.random.default_rng(SEED)
        script = known[:, FEATURES.index("word_length")] == CJK_LENGTH  # scripts without spaces get seeds of their own
        groups = [(label == c) & (script == s) for c in range(len(CLASSES)) for s in (False, True)]
        centres = [z[: len(known)][g].mean(axis=0) for g in groups if g.any()]
        gap = np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0)
        while len(centres) < COMPONENTS:
            c = z[rng.choice(len(z), p=gap / gap.sum()) if gap.sum() > 0 else 0]
            centres.append(c)
            gap = np.minimum(gap, ((z - c) ** 2).sum(axis=1))
        self.set(np.array(centres), np.repeat(np.eye(z.shape[1])[None], len(centres), axis=0), np.full(len(centres), 1.0 / len(centres)))
        before = -np.inf
        for _ in range(SEED_ROUNDS):
            sums, gain = self.sums(x)
            self.update(sums, len(x), known)
            if abs(gain / max(1, len(x)) - before) < 1e-4:
                break
            before = gain / max(1, len(x))
        return self

    def fit(self, x: np.ndarray, known: np.ndarray, label: np.ndarray) -> Mixture:
        """The mixture of rows held in memory."""
        return self.start(known, label, x).name(known, label)

    def set(self, mu: np.ndarray, cov: np.ndarray, weight: np.ndarray) -> None:
        """Take parameters, and the coefficients of each component's log density over :func:`_squares`."""
        self.mu, self.cov, self.weight = mu, cov, weight
        d = mu.shape[1]
        i, j = np.triu_indices(d)
        inverse = np.linalg.inv(cov)
        quad = -0.5 * inverse[:, i, j] * np.where(i == j, 1, 2)
        line = np.einsum("kab,kb->ka", inverse, mu)
        one = np.log(weight + 1e-300) - 0.5 * np.einsum("ka,ka->k", line, mu) - 0.5 * np.linalg.slogdet(cov)[1]
        self.linear = np.concatenate([one[:, None], line, quad], axis=1).T

    def shares(self, squares: np.ndarray) -> tuple[np.ndarray, float]:
        """Each row's share of each component, and the sum of log likelihoods."""
        log = squares @ self.linear
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((top + np.log(total)).sum())

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """The expectation step: sums of shares times :func:`_squares`, and of log likelihoods."""
        total, gain = np.zeros_like(self.linear.T), 0.0
        for a in range(0, len(x), 8192):
            q = _squares((x[a : a + 8192] - self.mean) / self.scale)
            r, g = self.shares(q)
            total += r.T @ q
            gain += g
        return total, gain

    def update(self, sums: np.ndarray, n: int, known: np.ndarray) -> None:
        """The maximization step. The inspected examples together weigh a fixed share, so that they
        hold components in place."""
        own, _ = self.sums(known)
        sums = sums + own * max(1.0, ANCHOR * n / len(known))
        d = self.mu.shape[1]
        weight = sums[:, 0] + 1e-9
        mu = sums[:, 1 : d + 1] / weight[:, None]
        i, j = np.triu_indices(d)
        cov = np.empty((len(mu), d, d))
        cov[:, i, j] = cov[:, j, i] = sums[:, d + 1 :] / weight[:, None] - mu[:, i] * mu[:, j]
        values, axes = np.linalg.eigh(cov)  # sums are rounded; keep it a covariance
        cov = np.einsum("kab,kb,kcb->kac", axes, np.maximum(values, 0), axes) + 0.02 * np.eye(d)
        self.set(mu, cov, weight / weight.sum())

    def name(self, known: np.ndarray, label: np.ndarray) -> Mixture:
        """Each component gets the class of most of the inspected examples nearest to its mean; statistics
        count by how well they part the classes of the examples."""
        e = (known - self.mean) / self.scale
        within = np.mean([e[label == c].var(axis=0) for c in range(len(CLASSES))], axis=0) + 0.05
        between = np.var([e[label == c].mean(axis=0) for c in range(len(CLASSES))], axis=0)
        gap = (((self.mu[:, None, :] - e[None]) ** 2) * (between / within)).sum(axis=2)
        nearest = label[np.argsort(gap, axis=1, kind="stable")[:, :NEIGHBOURS]]
        self.kind = np.array([np.bincount(x, minlength=len(CLASSES)).argmax() for x in nearest])
        return self

    def classes(self, x: np.ndarray) -> np.ndarray:
        """The most probable class of each row."""
        if not len(x):
            return np.empty(0, np.int64)
        p, _ = self.shares(_squares((x - self.mean) / self.scale))
        by = np.stack([p[:, self.kind == c].sum(axis=1) for c in range(len(CLASSES))], axis=1)
        # prose must hold a finished sentence, whatever else it looks like
        by[x[:, FEATURES.index("running")] == 0, 0] = 0
        return by.argmax(axis=1)


def examples(common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for c, name in enumerate(CLASSES):
        for text in EXAMPLES[name]:
            for lines in segments(text):
                x.append(measure(lines, common)[1])
                y.append(c)
    return np.array(x), np.array(y)


def _common(words: DataFrame) -> frozenset[str]:
    """The frequent words; the table is fixed, and its size is checked before it is fetched."""
    if words.count() > 100_000:
        raise ValueError("common_words is larger than a list of frequent words may be")
    return frozenset(r[0].lower() for r in words.where("word is not null").select("word").collect())


_COUNTS = ("chars", "words", "letters", "digits", "known")


def measured(documents: DataFrame, common: frozenset[str], key: str) -> DataFrame:
    """``key``, counts, the share of lines that end in punctuation, and for the document's segments
    their characters ``sizes`` (int32) and statistics ``x`` (float32), written once."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, totals, sizes, rows = [], [], [], []
            for t in b.column(1).to_pylist():
                counts, x = [], []
                end = 0.0
                if t and not t.isspace():
                    lines = [y[-1] for y in map(str.rstrip, t.splitlines()) if y]
                    end = sum(map(".!?:;,。！？…".__contains__, lines)) / max(1, len(lines))
                    for part in segments(t):
                        n, y = measure(part, common)
                        counts.append(n)
                        x.append(y)
                ends.append(end)
                n = np.array(counts, np.int64).reshape(-1, len(_COUNTS))
                totals.append(n.sum(axis=0))
                sizes.append(n[:, 0].astype(np.int32).tobytes())
                rows.append(np.array(x, np.float32).tobytes())
            total = np.array(totals, np.int64).reshape(-1, len(_COUNTS)).T
            cols = [b.column(0), *map(pa.array, total), pa.array(ends, pa.float64()), pa.array(sizes, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.record_batch(cols, names=[key, *_COUNTS, "ends", "sizes", "x"])

    schema = f"{key} {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", ends double, sizes binary, x binary"
    return cut(documents.select(key, "text").mapInArrow(run, schema))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)


def _added(held: DataFrame, sums) -> np.ndarray:
    """The sum over all segments of the vector that ``sums`` gives for some of them: one row for
    each number and task, then one aggregation; its length is that of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = sums(_rows(b.column(0)))
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(np.rint(total / GRAIN).astype(np.int64))], names=["k", "v"])

    got = {r[0]: r[1] for r in held.select("x").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v")).collect()}
    return np.array([got[k] for k in range(len(got))]) * GRAIN


def fit(held: DataFrame, known: np.ndarray, label: np.ndarray, key: str) -> Mixture:
    """The mixture of all segments of :func:`measured`."""
    d = len(FEATURES)
    held = held.where(F.length("x") > 0)
    first = _added(held, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    n = int(round(first[0])) if len(first) else 0
    both = n + len(known)
    mean = (known.sum(axis=0) + (first[1 : d + 1] if n else 0)) / both
    square = ((known * known).sum(axis=0) + (first[d + 1 :] if n else 0)) / both
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6
    hashed = held.select(F.xxhash64(key).alias("h"), "x")
    last = hashed.select("h").orderBy("h").limit(SEED_DOCUMENTS).agg(F.max("h")).first()[0]
    each = SEED_SEGMENTS // SEED_DOCUMENTS

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [np.frombuffer(v, np.float32).reshape(-1, d) for v in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x[:: max(1, len(x) // each)][:each].tobytes() for x in every], pa.binary())], names=["h", "x"])

    sample = sorted((r[0], bytes(r[1])) for r in hashed.where(F.col("h") <= F.lit(last)).mapInArrow(thin, "h long, x binary").collect())
    some = [np.frombuffer(x, np.float32).reshape(-1, d).astype(np.float64) for _, x in sample]
    model = Mixture(mean, scale).start(known, label, np.concatenate(some) if some else known)
    before = -np.inf
    for _ in range(ROUNDS if n else 0):
        now = model

        def step(x: np.ndarray, now=now) -> np.ndarray:
            total, gain = now.sums(x)
            return np.append(total.ravel(), gain)

        total = _added(held, step)
        model = Mixture(mean, scale)
        model.set(now.mu, now.cov, now.weight)
        model.update(total[:-1].reshape(now.linear.T.shape), n, known)
        gain = total[-1] / n
        if gain - before < GAIN:
            break
        before = gain
    return model.name(known, label)


_SCHEMA = "words long, mean_word_length double, symbol_share double, punctuated_lines double, common_share double, prose_share double, label string"


def statistics(documents: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, words, mean_word_length, symbol_share, punctuated_lines, common_share, prose_share, label``
    for each row.

    ``label`` is the class that holds most characters, 'prose' if more than half are prose. Null,
    empty and blank texts have no words, shares of 0 and the label 'empty'.
    """
    common = _common(words)
    known, label = examples(common)
    held = measured(documents, common, key)
    model = fit(held, known, label, key)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, words_, letters, digits, common_, ends = (b.column(k).to_numpy() for k in range(1, 7))
            parts = [np.frombuffer(x, np.int32) for x in b.column(7).to_pylist()]
            by = np.zeros((b.num_rows, len(CLASSES)))
            owner = np.repeat(np.arange(b.num_rows), [len(x) for x in parts])
            if len(owner):
                np.add.at(by, (owner, model.classes(_rows(b.column(8)))), np.concatenate(parts))
            some, word = np.maximum(chars, 1), np.maximum(words_, 1)
            share = by[:, 0] / some
            names = ["empty" if not n else "prose" if s > 0.5 else CLASSES[int(c.argmax())] if c.argmax() else "mixed" for n, s, c in zip(chars, share, by, strict=True)]
            stats = [letters / word, (chars - letters - digits) / some, ends, common_ / word, share]
            yield pa.record_batch(
                [b.column(0), b.column(2), *(pa.array(np.round(c, 6)) for c in stats), pa.array(names, pa.string())],
                names=[key, *(x.split()[0] for x in _SCHEMA.split(", "))],
            )

    return held.select(key, *_COUNTS, "ends", "sizes", "x").mapInArrow(run, f"{key} {kind}, {_SCHEMA}")


def found(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id`` of each document more than half of whose characters are running sentences."""
    return statistics(documents, words).where("prose_share > 0.5").select("doc_id")
