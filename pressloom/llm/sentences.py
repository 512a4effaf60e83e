"""Problem 3: sentence units in all languages and scripts of the archive, with offsets.

A line is a lattice of possible ends: clusters of terminators, the closing marks that may
follow them, and quotations, which are taken as wholes. Each node is judged by the words on
both of its sides: abbreviations and initials before a period, case, script and reporting
words after it.

Runs of scripts without spaces are segmented, whatever their length, by the cheapest path
through a word lattice. Its dictionary is mined from the corpus: every run of up to four
characters that is frequent enough, with how often it stands at the end and at the beginning
of a statement. A gap inside a run is an end where the word before it is a final and the
word behind it an opening one, by these counts; listed particles and openers are where the
counts start from. The dictionary holds at most one entry for a fixed share of the corpus,
so its size has a bound. Everything else is done where a row lies; only offsets leave it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut_lineage, spread
from pressloom.sources.tables import table

_LINE = re.compile(r"[^\n\r\f\v\x1c-\x1e\x85  ]+")
_LIST = re.compile(r"(?:\(?\d{1,3}[.)]|\(?[a-zA-Z][)]|\(?[ivx]{1,4}[.)]|[-*•‣▪–]|[౦-౯०-९]{1,3}[.)])\s+(?=\S)")
_NODE = re.compile(r"[.!?।॥۔؟。！？…｡]+|[“”‘’\"'「」『』«»]")
_STRONG = set("।॥۔؟。！？｡")
_OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", '"': '"', "'": "'"}
_AFTER = set(")]}）】》")

#: Abbreviations after which a statement always goes on.
_NEVER = frozenset(
    "rs dr mr mrs ms smt sri shri no nos sec secs art p pp vol est approx vs viz i.e e.g cf ca st prof adv hon fig figs ref capt col gen lt maj sgt gov sr rev messrs g.o.ms.no g.o.rt.no g.o g.o.ms ms.no op cit ed eds ch para cl sl s.no"
    " రూ డా శ్రీ శ్రీమతి కి కి.మీ మీ జి.ఓ జి ఓ నెం సం ప్రొ कि कि.मी मी रु डॉ डा सं नं प्रो श्रीमती क्र पृ".split()
)
#: Abbreviations that may also end one.
_MAYBE = frozenset("etc ltd dept corpn corp co inc p.m a.m pm am jr bros govt assn ph.d m.sc b.sc m.a b.a m.d u.s u.k".split())
_LINKS = frozenset("OVER AND OR TO IN AT BY FOR FROM WITH OF ON BUT AGAINST UNDER AS THE A WAS WERE IS SINCE BEFORE AFTER ABOUT".split())
_INITIALS = re.compile(r"(?:[A-Z]\.)*[A-Z]$")
_REPORTS = re.compile(
    r"\W*(?:అని\b|అంటూ|ani\b|antu\b)|(?:\S+\s+){0,9}?(?:told|asked|said|says|added|replied|alleged|complained|declared|claimed|wrote|stated|insisted|answered|warned|announced|shouted|annaru|adigaru|kaha|poocha|puchha|bole|bola|boli)\b"
    r"|[^।॥۔؟!?.]{0,140}(?:कहा|पूछा|बोल[ेाी]|बताया|అన్నారు|అడిగారు|చెప్పారు|کہا|پوچھا|بولے|بتایا)|[^。！？]{0,60}[说問问道称]"
)
_FINAL = {"了", "吗", "呢", "吧", "啊", "的", "呀", "嘛", "着", "过", "です", "ます", "ました", "だ", "か", "よ", "ね", "ครับ", "ค่ะ", "คะ", "แล้ว", "นะ"}
_OPENING = {"为什么", "据", "从", "我们", "他们", "但是", "因此", "而且", "然后", "如果", "虽然", "这", "那", "在", "今天", "昨天", "同时", "此外", "不过", "しかし", "そして", "また", "それ", "これ", "แต่", "และ", "เขา", "เรา", "ถ้า"}
#: Listed particles that also stand inside statements and so prove nothing by themselves.
_INNER = {"的", "着", "过", "か", "だ"}
_LETTERS = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿"
_SPACELESS = re.compile(f"[{_LETTERS}]+")
#: Longest dictionary word; entries rarer than one in so many characters are not in the dictionary.
WORD, SHARE = 4, 200_000
#: Weight of the lists, against so many counted occurrences; least chances of both sides and of the gap.
LISTED, PRIOR, SIDE, GAP = 0.6, 4.0, 0.2, 0.15
_CLOSED = "。！？｡.!?…；;\n\r\f\v"


class Lexicon:
    """Words of spaceless scripts: how often, how often last and how often first."""

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None) -> None:
        self.counts = counts or {}
        self.total = max(sum(n for w, (n, _, _) in self.counts.items() if len(w) == 1), 1)
        self.unknown = -log(0.5 / self.total) + 1.0
        self.cost = {w: -log(n / self.total) for w, (n, _, _) in self.counts.items()}

    def last(self, w: str) -> float:
        n, e, _ = self.counts.get(w, (0, 0, 0))
        return (e + PRIOR * (LISTED if w in _FINAL and w not in _INNER else 0.0)) / (n + PRIOR)

    def first(self, w: str) -> float:
        n, _, b = self.counts.get(w, (0, 0, 0))
        return (b + PRIOR * (LISTED if w in _OPENING else 0.0)) / (n + PRIOR)

    def words(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the words on the cheapest path through the lattice of a run."""
        n = len(run)
        best = [0.0] + [1e18] * n
        back = [0] * (n + 1)
        for i in range(n):
            here = best[i]
            for k in range(1, min(WORD, n - i) + 1):
                w = run[i : i + k]
                c = self.cost.get(w)
                if c is None:
                    if w in _FINAL or w in _OPENING:
                        c = self.unknown
                    elif k == 1:
                        c = self.unknown
                    else:
                        continue
                if here + c < best[i + k]:
                    best[i + k], back[i + k] = here + c, i
        out, at = [], n
        while at:
            out.append((back[at], at))
            at = back[at]
        return out[::-1]

    def ends(self, run: str) -> list[int]:
        """Offsets in a run after which a new statement begins."""
        ws = self.words(run)
        out = []
        for (a, b), (c, d) in zip(ws, ws[1:]):
            x, y = self.last(run[a:b]), self.first(run[c:d])
            if x >= SIDE and y >= SIDE and x * y >= GAP and b >= 4 and len(run) - b >= 4:
                out.append(b)
        return out


#: The lists alone, for texts without a corpus.
_LISTED = Lexicon()


def count_runs(text: str, counts: dict) -> None:
    """Add the runs of up to WORD characters of a text to counts: [all, last, first]."""
    size = len(text)
    for m in _SPACELESS.finditer(text):
        run, i, j = m.group(), m.start(), m.end()
        n = len(run)
        for a in range(n):
            for b in range(a + 1, min(a + WORD, n) + 1):
                counts[run[a:b]][0] += 1
        if j == size or text[j] in _CLOSED:
            for k in range(1, min(WORD, n) + 1):
                counts[run[n - k :]][1] += 1
        if not i or text[i - 1] in _CLOSED:
            for k in range(1, min(WORD, n) + 1):
                counts[run[:k]][2] += 1


def mined(texts: DataFrame) -> Lexicon:
    """The dictionary of a one-column table of texts, counted over all of them."""

    def rows(counts: dict) -> pa.RecordBatch:
        cols = list(zip(*counts.values())) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], ["w", "n", "e", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                count_runs(t, counts)
            if len(counts) > 500_000:
                yield rows(counts)
                counts.clear()
        yield rows(counts)

    name = texts.columns[0]
    some = texts.where(F.col(name).rlike(f"[{_LETTERS}]"))
    counted = cut_lineage(some.mapInArrow(count, "w string, n bigint, e bigint, b bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("b").alias("b")))
    total = counted.where(F.length("w") == 1).agg(F.sum("n")).first()[0] or 0
    kept = counted.where(F.col("n") >= F.lit(max(2, -(-total // SHARE)))).collect()  # at most WORD * SHARE rows
    return Lexicon({r.w: (r.n, r.e, r.b) for r in kept})


def _quotes(line: str, nodes: list) -> dict[int, int]:
    """Opening -> closing position of the outermost quotations of a line."""
    pairs: dict[int, int] = {}
    opened, want = -1, ""
    size = len(line)
    for m in nodes:
        c = m.group()
        if c[0] not in "“”‘’\"'「」『』«»":
            continue
        i = m.start()
        before, after = line[i - 1] if i else " ", line[i + 1] if i + 1 < size else " "
        if opened < 0:
            if c not in _OPEN or after.isspace():
                continue
            if c in "\"'‘" and not (before.isspace() or before in "([{—–-:。！？，" or (c != "'" and not before.isalnum() and before not in ".,!?")):
                continue
            if c == "'" and not after.isalnum():
                continue
            opened, want = i, _OPEN[c]
        elif c == want and not (c in "'’" and (after.isalnum() or (before in "sS" and after == " " and line.find(want, i + 1) >= 0 and not line[i + 2 : i + 3].islower()))):
            pairs[opened] = i
            opened = -1
    return pairs


def _ends(line: str, lexicon: Lexicon | None = None) -> list[int]:
    """Offsets inside a line after which a new unit begins."""
    nodes = list(_NODE.finditer(line))
    ends: list[int] = []
    size, start = len(line), 0
    quotes = _quotes(line, nodes) if any(m.group()[0] in "“‘\"'「『«" for m in nodes) else {}
    closers = {b: a for a, b in quotes.items()}
    until = -1

    def after(i: int) -> tuple[int, str]:
        while i < size and line[i].isspace():
            i += 1
        return i, line[i : i + 1]

    for m in nodes:
        i, j = m.span()
        c = m.group()
        if i < until:
            continue
        if i in quotes:
            until = quotes[i]
            continue
        cut = -1
        if i in closers:
            opened = closers[i]
            k, nxt = after(j)
            if line[i - 1] in ".!?…" or line[i - 1] in _STRONG:
                if not nxt or nxt.islower() or nxt in ".!?,;:)—–" or nxt in _STRONG or nxt in "，、；：":
                    continue
                if line[start:opened].strip(" \t([{—–-"):
                    cut = j
                elif k in quotes or not _REPORTS.match(line[k:]):
                    cut = j
        elif c[0] in _OPEN or c[0] in "”’」』»":
            continue
        else:
            while j < size and line[j] in _AFTER:
                j += 1
            if j in closers and j > i:
                continue
            k, nxt = after(j)
            if not nxt:
                break
            if _STRONG.intersection(c):
                cut = j
            elif "!" in c or "?" in c:
                cut = -1 if nxt.islower() or nxt in ",;:" else j
            elif "…" in c or len(c) > 1:
                cut = j if i and line[i - 1].isspace() and not nxt.islower() and nxt not in ",;:" else -1
            else:
                cut = j if _period(line, i, j, k, nxt) else -1
        if cut > 0:
            ends.append(cut)
            start = cut
    for run in _SPACELESS.finditer(line):
        if run.end() - run.start() >= 8:  # four characters on each side of a gap
            inner = [run.start() + x for x in (lexicon or _LISTED).ends(run.group())]
            ends.extend(x for x in inner if not any(a < x <= b for a, b in quotes.items()))
    return sorted(set(ends))


def _period(line: str, i: int, j: int, k: int, nxt: str) -> bool:
    """Whether the period at i ends a unit; the next word begins at k with nxt."""
    a = i
    while a and not line[a - 1].isspace():
        a -= 1
    token = line[a:i].lstrip("([{\"'“‘«—–-")
    low = token.lower()
    if k == j:  # no space follows
        if nxt.isdigit() or nxt in ".,;:-/)":
            return False
        last = token.rsplit(".", 1)[-1]
        if low in _NEVER or low in _MAYBE or last.lower() in _NEVER:
            return False
        if nxt.isascii():
            return nxt.isupper() and (last.isdigit() or (len(last) >= 3 and last[-1:].islower()) or not last.isascii()) and line[k + 1 : k + 2] != "."
        return len(last) >= 4
    if nxt.islower():
        return False
    last = token.rsplit(".", 1)[-1]
    if low in _NEVER or last.lower() in _NEVER:
        return False
    if low in _MAYBE and token.isupper() and not any(c.islower() for c in line):
        # without case, the next word has to tell; only the time of day ends a statement often
        word = re.match(r"[A-Z]+", line[k:])
        return low in ("p.m", "a.m") and word is not None and word.group() not in _LINKS
    if _INITIALS.match(token) or (len(last) == 1 and last.isupper()):
        return False
    if not token.isascii() and "." in token and len(token) <= 6:
        return False
    return True


def _single(line: str) -> bool:
    """Headings, list items and table rows are one unit."""
    return line[0] == "#" or "\t" in line or line.count(" | ") >= 2 or bool(_LIST.match(line))


def sentences(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit; together they cover all but white space."""
    units: list[tuple[int, int]] = []
    for m in _LINE.finditer(text or ""):
        raw = m.group()
        line = raw.strip()
        if not line:
            continue
        base = m.start() + len(raw) - len(raw.lstrip())
        at = 0
        for e in [*([] if _single(line) else _ends(line, lexicon)), len(line)]:
            piece = line[at:e]
            lead = len(piece) - len(piece.lstrip())
            if body := piece.strip():
                units.append((base + at + lead, base + at + lead + len(body)))
            at = e
    return units


def units(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_id, sent_start, sent_end), each once, for every sentence unit.

    Offsets count code points of the text as it stands. Null, empty and blank texts have no
    units; equal rows count once; a text of marks only is one unit a line. Rows of one id
    with different texts have the units of each. Other columns are not read.
    """
    kind = df.schema[item_id].dataType.simpleString()
    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    shipped = df.sparkSession.sparkContext.broadcast(mined(rows.select("text")).counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(shipped.value)
        for b in batches:
            found = [sentences(t, own) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[s for s, _ in u] for u in found], pa.list_(pa.int32())), pa.array([[e for _, e in u] for u in found], pa.list_(pa.int32()))], ["item_id", "starts", "ends"]
            )

    # equal rows meet while a row is still one row
    once = spread(rows).mapInArrow(run, f"item_id {kind}, starts array<int>, ends array<int>").distinct()
    flat = once.select("item_id", F.explode(F.arrays_zip("starts", "ends")).alias("u"))
    return flat.select("item_id", F.col("u.starts").alias("sent_start"), F.col("u.ends").alias("sent_end"))


def found(spark, sf_dir: str) -> DataFrame:
    return units(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text").withColumnRenamed("item_id", "chunk_id")


def segment_units(spark, sf_dir: str) -> DataFrame:
    return units(table(spark, sf_dir, "segments", "segment_id", "text_original"), "segment_id", "text_original").withColumnRenamed("item_id", "segment_id")
