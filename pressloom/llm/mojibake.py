"""Problem 5: text that was read with the wrong character encoding.

Every pair of adjacent characters is scored by its mutual information in the corpus. What a
wrong reading leaves behind always stands together, so its pairs must not vouch for each
other: the characters are counted over all text, the pairs only over text that no wrong
reading explains (no sequence in it is valid UTF-8 under a wrong encoding). Pairs too rare
to judge are judged by their classes. Runs whose pairs are improbable are isolated as
maximum-scoring segments, and only inside them the inverse mappings are tried, again where
it was done twice; the mapping whose result the corpus finds least improbable is taken, if
it takes most of the improbability away. A run that no mapping explains is still a case
where it shows replacement characters, or consists of the accented letters and symbols that
8-bit Indic fonts and codes turn into. Accented or foreign words are neither.

The counts are tables of fixed size: characters by code unit, pairs in two hashed rows of
which the smaller count holds, so what is sent to the executors does not grow with the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import spread
from pressloom.sources.tables import table

#: Encodings that UTF-8 bytes are commonly read with by mistake; those of two bytes a character apart.
CODECS = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "koi8_r", "cp1250", "cp1254", "cp866", "iso8859_15")
WIDE = ("gb18030", "big5")
#: Mutual information below which a pair is improbable, the most one pair counts, the least score of a run.
IMPROBABLE, MOST, LEAST = -0.25, 3.0, 2.0
#: A pair expected less often than this is judged by its classes.
EXPECTED = 3.0
#: Share of a run's improbability that may be left when a mapping is taken.
LEFT = 0.34
_N, _UNITS, _SLOTS = 64, 1 << 16, 1 << 20
#: Characters that layout and scanning leave behind and that no wrong encoding explains.
_LAYOUT = set("­¬†‡ﬀﬁﬂﬃﬄ■□●○◦▪")
_BLOCKS = [(0x00, 0x7F), (0x80, 0x9F), (0xA0, 0xBF), (0xC0, 0xFF), (0x100, 0x24F), (0x250, 0x36F), (0x370, 0x3FF), (0x400, 0x52F), (0x600, 0x77F), (0x900, 0x97F), (0xC00, 0xC7F), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x214F), (0x2190, 0x23FF), (0x2500, 0x25FF), (0x3000, 0x303F), (0x3400, 0x9FFF), (0xE000, 0xF8FF), (0xFF00, 0xFFEF), (0xFFFD, 0xFFFD)]


def _classes() -> np.ndarray:
    """Class of every 16-bit code unit: its block, split by letter, capital and the rest."""
    kinds: dict = {}
    out = np.zeros(1 << 16, np.uint8)
    block = np.full(1 << 16, len(_BLOCKS), np.uint8)
    for k, (a, b) in enumerate(_BLOCKS):
        block[a : b + 1] = k
    for cp in range(1 << 16):
        if block[cp] == len(_BLOCKS) or block[cp] in (17, 18):
            sort = "x"
        else:
            cat = unicodedata.category(chr(cp))
            sort = "L" if cat in ("Lu", "Lt") else "l" if cat[0] in "LM" else "s" if cat[0] == "Z" or chr(cp).isspace() else "o"
        out[cp] = kinds.setdefault((block[cp], sort), len(kinds))
    if len(kinds) > _N:
        raise AssertionError("too many classes")
    return out


_TABLE: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def _codes(text: str) -> np.ndarray:
    """One 16-bit unit for every character; those beyond the first plane share one."""
    if len(data := text.encode("utf-16-le", "surrogatepass")) != 2 * len(text):
        data = "".join(c if c < "\U00010000" else "\uffff" for c in text).encode("utf-16-le", "surrogatepass")
    return np.frombuffer(data, np.uint16)


def _slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = (a.astype(np.uint64) << np.uint64(16)) | b
    with np.errstate(over="ignore"):
        return tuple(((key * m) >> np.uint64(44)).astype(np.int32) for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)))


class Information:
    """Counts of characters, of pairs (two hashed rows) and of class pairs, and the mutual
    information they give."""

    SHAPE = (_UNITS, _SLOTS, _SLOTS, _N * _N)

    def __init__(self, counts: list[np.ndarray] | None = None) -> None:
        self.units, self.first, self.second, self.pairs = counts or [np.zeros(n, np.int64) for n in self.SHAPE]
        self._ready = False

    def add(self, text: str) -> None:
        """Count a text: all its characters, and the pairs of what no wrong reading explains."""
        self.units += np.bincount(_codes(text), minlength=_UNITS)
        c = _codes(unexplained(text))
        a, b = c[:-1], c[1:]
        keep = (a != 10) | (b != 10)
        a, b = a[keep], b[keep]
        x, y = _slots(a, b)
        self.first += np.bincount(x, minlength=_SLOTS)
        self.second += np.bincount(y, minlength=_SLOTS)
        k = _class_table().astype(np.int32)
        self.pairs += np.bincount(k[a] * _N + k[b], minlength=_N * _N)

    def counts(self) -> list[np.ndarray]:
        return [self.units, self.first, self.second, self.pairs]

    def _prepare(self) -> None:
        n = self.units.astype(np.float64)
        self.share = n / max(n.sum(), 1.0)
        of = np.bincount(_class_table(), weights=n, minlength=_N)
        expected = np.outer(of, of) / max(n.sum(), 1.0)
        self.by_class = np.log((self.pairs.reshape(_N, _N) + 0.05) / (expected + 0.05)).ravel()
        self.total, self._ready = n.sum(), True

    def mutual(self, c: np.ndarray) -> np.ndarray:
        """Mutual information of every adjacent pair of a text in codes."""
        if not self._ready:
            self._prepare()
        a, b = c[:-1], c[1:]
        expected = self.share[a] * self.share[b] * self.total
        x, y = _slots(a, b)
        own = np.log((np.minimum(self.first[x], self.second[y]) + 0.5) / (expected + 0.5))
        k = _class_table().astype(np.int32)
        return np.where(expected >= EXPECTED, own, self.by_class[k[a] * _N + k[b]])

    def scores(self, text: str, left: str = "\n", right: str = "\n") -> np.ndarray:
        """Improbability of every adjacent pair, with what stands around the text."""
        c = _codes(left + text + right)
        s = np.clip(IMPROBABLE - self.mutual(c), -MOST, MOST)
        odd = (c == 0xFFFD) | (self.units[c] == 0)  # stands for no character, or was never seen
        s[odd[:-1] | odd[1:]] = MOST
        return s

    def improbability(self, text: str, left: str = "\n", right: str = "\n") -> float:
        s = self.scores(text, left, right)
        return float(s[s > 0].sum())


def _images(codec: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)  # commonly passed through as a control character
        out[c] = b
    return out


class _Inverse:
    """Undoes one wrong reading of UTF-8."""

    def __init__(self, codec: str) -> None:
        self.codec, self.back = codec, _images(codec)
        chars = {b: re.escape(c) for c, b in self.back.items()}
        lead = lambda a, b: "[" + "".join(chars[x] for x in range(a, b + 1) if x in chars) + "]"
        tail = "[" + "".join(chars[x] for x in range(0x80, 0xC0) if x in chars) + "�]"
        self.leads = lead(0xC2, 0xF4)[1:-1]
        #: The same behind a first character that some encoding may lead with.
        self.behind = "|".join(f"(?<={lead(a, b)}){tail}{{{n}}}" for a, b, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)))
        self.pattern = re.compile(f"[{self.leads}](?:{self.behind})")

    def undo(self, text: str) -> tuple[str, int, int]:
        """(text restored, sequences restored, sequences that are lost in part)."""
        done = lost = 0

        def one(m: re.Match) -> str:
            nonlocal done, lost
            s = m.group()
            if "�" in s:
                lost += 1
                return "�"
            try:
                c = bytes(self.back[x] for x in s).decode()
            except UnicodeDecodeError:
                return s
            done += 1
            return c

        return self.pattern.sub(one, text), done, lost


class _Wide:
    """Undoes a reading in an encoding of two bytes a character: a whole run must map back."""

    pattern = re.compile(r"[㐀-鿿\ue000-\uf8ff][\ue000-\uf8ff㐀-鿿＀-￯、-〿ŀ-῿†-⿿¡-ÿ]{2,}")

    def __init__(self, codec: str) -> None:
        self.codec = codec

    def _one(self, s: str) -> tuple[str, bool] | None:
        try:
            head = s[:2].encode(self.codec)
            if not (0xE0 <= head[0] <= 0xF4 and 0x80 <= head[1] < 0xC0 and 0x80 <= head[2] < 0xC0):  # no beginning of UTF-8
                return None
            data = s.encode(self.codec)
        except UnicodeEncodeError:
            return None
        for cut in (0, 1, 2):  # the last character may have lost its end
            try:
                return data[: len(data) - cut].decode() + "�" * (cut > 0), cut == 0
            except UnicodeDecodeError:
                continue
        return None

    def undo(self, text: str) -> tuple[str, int, int]:
        done = lost = 0

        def one(m: re.Match) -> str:
            nonlocal done, lost
            back = self._one(m.group())
            if back is None:
                return m.group()
            done, lost = done + len(back[0]), lost + (not back[1])
            return back[0]

        return self.pattern.sub(one, text), done, lost


_INVERSES: list = []


def _inverses() -> list:
    if not _INVERSES:
        _INVERSES.extend(_Inverse(c) for c in CODECS)
        _INVERSES.extend(_Wide(c) for c in WIDE)
    return _INVERSES


#: Three and more letters and symbols of the upper half of 8-bit sets in a row, as 8-bit fonts leave them.
_UPPER = r"\x80-ſŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_EXPLAINED: list[re.Pattern] = []


def _explained() -> re.Pattern:
    """What some wrong reading of UTF-8, a replacement or an 8-bit font can leave behind."""
    if not _EXPLAINED:
        plain = [i for i in _inverses() if isinstance(i, _Inverse)]
        # one set of first characters, so that the search passes over all others at once
        behind = "|".join([*dict.fromkeys(i.behind for i in plain), "(?<=�)", f"(?<=[{_UPPER}])[{_UPPER}]{{2,}}"])
        _EXPLAINED.append(re.compile(f"[{''.join(i.leads for i in plain)}�{_UPPER}](?:{behind})"))
    return _EXPLAINED[0]


def _wide(text: str) -> bool:
    """Whether a run of the text maps back as a whole from an encoding of two bytes."""
    return any(any(i._one(m.group()) for i in _inverses() if isinstance(i, _Wide)) for m in _Wide.pattern.finditer(text))


def unexplained(text: str) -> str:
    """The text with line breaks for everything that a wrong reading explains."""
    text = _explained().sub("\n", text)
    return _Wide.pattern.sub(lambda m: "\n" if _wide(m.group()) else m.group(), text)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time. Numbers
    of one sign that stand together are added up first, as no segment ends among them."""
    if not len(scores):
        return []
    turns = np.flatnonzero(np.diff(scores > 0)) + 1
    starts = np.concatenate([[0], turns])
    ends = np.concatenate([turns, [len(scores)]])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for a, b, s in zip(starts.tolist(), ends.tolist(), np.add.reduceat(scores, starts).tolist()):
        if s <= 0:
            total += s
            continue
        start, left, total = a, total, total + s
        right = total
        while found:
            k = next((k for k in range(len(found) - 1, -1, -1) if found[k][2] < left), -1)
            if k < 0 or found[k][3] >= right:
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
        found.append((start, b, left, right))
    return [(a, b, right - left) for a, b, left, right in found]


def runs(text: str, info: Information) -> list[tuple[int, int]]:
    """Improbable runs of a text, as offsets widened to the words they lie in."""
    out: list[tuple[int, int]] = []
    for a, b, s in segments(info.scores(text)):
        if s < LEAST:
            continue
        a, b = max(a - 1, 0), min(b, len(text))  # pairs to characters; a break stands before the first
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def restore(run: str, info: Information, left: str = "\n", right: str = "\n") -> tuple[str, str | None, bool]:
    """(run restored as far as possible, what was wrong or None, whether nothing is lost); left
    and right are the characters around it."""
    best: tuple | None = None
    scores = np.maximum(info.scores(run, left, right), 0.0)
    before = float(scores.sum())
    for inv in _inverses() if _explained().search(run) or _wide(run) else ():
        text, done, lost = run, 0, 0
        for _ in range(3):
            nxt, n, gone = inv.undo(text)
            if (not n and not gone) or nxt == text:
                break
            text, done, lost = nxt, done + n, lost + gone
        if done + lost:
            touched = np.zeros(len(scores), bool)
            for m in inv.pattern.finditer(run):
                touched[m.start() : m.end() + 1] = True  # pair k joins characters k - 1 and k
            # what is lost in part is no fault of the mapping
            after = info.improbability(text.replace("�", "") if lost else text, left, right)
            rank = (after, lost, -done)
            if best is None or rank < best[0]:
                own = float(scores[touched].sum())
                best = (rank, text, inv.codec, lost, after - (before - own) <= LEFT * own)
    if best and best[4]:
        return best[1], best[2], not best[3] and "�" not in best[1]
    if "�" in run:
        return run, "replaced", False
    if _coded(run):
        return run, "font", False
    return run, None, True


_IN_WORD = re.compile(r"[A-Za-zÀ-ÿ](?![’·°ºª'])[¡-¿×÷ƒˆ˜†‡•…‰‹›€™]+(?=[A-Za-zÀ-ÿ])|[a-zà-ÿ][À-ÖØ-Þ](?=[a-zà-ÿ])")
_BEFORE = re.compile(r"(?<!\S)[\x80-\x9f¡-ÿ](?<![«„])(?=[A-Z][a-z]+|[A-Z][a-z]?\.|the\b|\d)")
_BEHIND = re.compile(r"[A-Za-z][.!?,][\x80-\x9f¡-ÿ](?<!»)(?!\S)")

_ODD = re.compile(r"[\x80-ÿƒˆ˜†‡•…‰‹›€™]")
_AROUND = [(_BEFORE, _BEHIND), (re.compile(r"(?<![^\s'\"(])[\x80-\x9f¡-Þ](?<![«„¿¡°º])(?=[a-z]{3})"), re.compile(r"[a-z]{2}[\x80-\x9f¡-Þ](?<![»°ºª])(?![^\s'\"),.])"))]


def _swapped(text: str) -> bool:
    """Whether single characters stand for others all through a text: symbols and capitals
    inside words, or letters and symbols in the places of quotes."""
    if not _ODD.search(text):
        return False
    if sum(1 for m in _IN_WORD.finditer(text) if not _LAYOUT.intersection(m.group())):
        return True
    return any(before.search(text) and behind.search(text) for before, behind in _AROUND)


def _coded(run: str) -> bool:
    """Whether accented letters and symbols stand for something else: they make up most of a
    run of some length, in an order no language writes."""
    body = [c for c in run if not c.isspace() and not c.isdigit() and c not in ".,;:!?()'\"-"]
    odd = [c for c in body if "\x80" <= c <= "ſ" or c in "ŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™" or "" <= c <= ""]
    if len(odd) < 5 or len(odd) < 0.55 * len(body):
        return False
    wild = sum(1 for a, b in zip(run, run[1:]) if (a.islower() and b.isupper()) or (a.isalpha() and "\x80" <= b <= "¿") or ("\x80" <= a <= "¿" and b.isalpha()) or (a.isupper() and b.isupper() and a > "\x7f" and b > "\x7f"))
    return wild >= 2


def damageable(text: str) -> bool:
    """Whether anything in a text could be damage of a known kind; exact, and cheap."""
    return _explained().search(text) is not None or _swapped(text) or _wide(text)


def repair(text: str | None, info: Information) -> tuple[str | None, list[str], bool]:
    """(text with its runs restored, kinds of damage, whether all of it could be restored)."""
    if not text or not damageable(text):
        return text, [], True
    kinds: list[str] = []
    whole = True
    out, at = [], 0
    found = runs(text, info)
    for a, b in found:
        fixed, kind, full = restore(text[a:b], info, text[a - 1 : a] or "\n", text[b : b + 1] or "\n")
        if kind:
            kinds.append(kind)
            whole = whole and full
            out += [text[at:a], fixed]
            at = b
    if not kinds and _swapped(" ".join(text[a:b] for a, b in found)):
        return text, ["font"], False
    return ("".join(out) + text[at:] if kinds else text), sorted(set(kinds)), whole


def corpus_information(texts: DataFrame) -> Information:
    """The counts over a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Information()
        for b in batches:
            part: list[str] = []
            size = 0
            for t in b.column(0).to_pylist():
                if t:
                    part.append(t)
                    size += len(t)
                if size > 4_000_000:
                    own.add("\n" + "\n".join(part) + "\n")
                    part, size = [], 0
            if part:
                own.add("\n" + "\n".join(part) + "\n")
        base = 0
        at, n = [], []
        for counts in own.counts():
            k = np.flatnonzero(counts)
            at.append(k + base)
            n.append(counts[k])
            base += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(n))], ["at", "n"])

    rows = texts.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most the tables' fixed size
    flat = np.zeros(sum(Information.SHAPE), np.int64)
    flat[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return Information([x.copy() for x in np.split(flat, np.cumsum(Information.SHAPE)[:-1])])


def repaired(df: DataFrame, item_id: str, text: str, information: Information | None = None) -> DataFrame:
    """Rows (item_id, kinds, restored, text) of the records with text from a wrong encoding.

    kinds names the encodings, ``replaced`` for replacement characters and ``font`` for
    8-bit codes; restored tells whether nothing was lost; text is the whole text with every
    run restored as far as possible. Null, empty and clean texts have no row. Repeated rows
    are repeated. Other columns are not read.
    """
    kind = df.schema[item_id].dataType.simpleString()
    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    info = corpus_information(rows.select("text")) if information is None else information
    counts = df.sparkSession.sparkContext.broadcast(info.counts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Information(counts.value)
        for b in batches:
            at, kinds, full, texts = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                fixed, k, whole = repair(t, own)
                if k:
                    at.append(i)
                    kinds.append(k)
                    full.append(whole)
                    texts.append(fixed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.list_(pa.string())), pa.array(full, pa.bool_()), pa.array(texts, pa.string())], ["item_id", "kinds", "restored", "text"]
            )

    return spread(rows).mapInArrow(run, f"item_id {kind}, kinds array<string>, restored boolean, text string")


def report(spark, sf_dir: str) -> DataFrame:
    """Segments and extracted files with damage, restored; one statistic serves both."""
    seg = table(spark, sf_dir, "segments", "segment_id", "text_original")
    doc = table(spark, sf_dir, "extracted_docs", "source_file", "error")
    mi = corpus_information(seg.select("text_original").unionAll(doc.select("error")))
    a = repaired(seg, "segment_id", "text_original", mi).withColumn("record_kind", F.lit("segment"))
    b = repaired(doc, "source_file", "error", mi).withColumn("record_kind", F.lit("extracted_doc"))
    return a.unionByName(b).select("record_kind", F.col("item_id").alias("record_id"), "kinds", "restored", "text")


def found(spark, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("record_kind", "record_id").distinct()
