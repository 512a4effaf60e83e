"""Problem 7: the language of every record, and of every part of a mixed one.

Compression classification. From a bounded sample of records, sentences that the script or
a few grammatical words place beyond doubt become one raw-content zstandard dictionary per
language and script. A text is encoded with each of them and belongs to the one that makes
it smallest; where the margin is narrow a sentence is not decided by itself but takes the
language of the rest of its record, and where the margin of all a record has in one script
is next to nothing, no dictionary fits and it is undetermined. Names and figures are left out before encoding. Parts
are sentence units; a record is mixed where a second language fills enough of it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.sentences import sentences
from pressloom.session import spread
from pressloom.sources.tables import table

#: Records sampled to fit the dictionaries, and bytes of each dictionary.
SAMPLE, DICTIONARY = 6000, 48 * 1024
LEVEL = 6
#: Least relative difference between the two smallest encodings.
MARGIN = 0.03
#: Least difference for everything a record has in one script; below it the language is UNKNOWN.
REJECT, UNKNOWN = 0.05, "und"
#: Share of the text from which a second language makes a record mixed.
MIXED = 0.175

_SCRIPTS = [("latn", r"A-Za-zÀ-ɏ"), ("telu", r"ఀ-౿"), ("deva", r"ऀ-ॿ"), ("arab", r"؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"), ("hani", r"㐀-䶿一-鿿")]
_BY_SCRIPT = {name: re.compile(f"[{chars}]") for name, chars in _SCRIPTS}
_HOME = {"telu": "te", "deva": "hi", "arab": "ur", "hani": "zh"}
#: Grammatical words of the languages that occur in Latin letters; they only seed the fit.
_SEEDS = {
    "en": "the of and to in a is was were by with for at from on that not this an as which under over against without had would be been has who why what where their before after between".split(),
    "te": "ku lo ni nu na ki mariyu ani gurinchi nunchi varaku tho kosam valla kinda prakaram lekkala peruto kalisi matrame inka enduku evaru ekkada ela ledu kaadu undi unnaru chesaru annaru adigaru cheppindi chepparu icharu ichina pampina tarvata mundu gatha oka okka rendo moodo andaledu ivvaledu raaledu vachindi ayindi chivari kotha paatha malli".split(),
    "hi": "ka ke ki ko ne se mein par aur hai hain tha thi the nahin kya kyon kisne kaun kahan kab tak mila mile liye saath baad pehle bheje bheja kaha diya kiya gaya hua hue wala ek bhi sirf lekin magar yeh woh naye purane sabhi anusar naam rashi teesri baar der raat subah milkar".split(),
}
_SEED_SETS = {k: frozenset(v) for k, v in _SEEDS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_FIGURES = re.compile(r"[\d٠-٩०-९౦-౯][\d.,:/-]*")
_NAME = re.compile(r"(?<=[\s(“‘\"'])(?:[A-Z]\.?)+[a-zÀ-ɏ]*\.?(?=[\s,.;:!?)”’\"']|$)|\b[A-Z]\.")


def script(text: str) -> str | None:
    """The script most letters of a text are in."""
    n = {name: len(p.findall(text)) for name, p in _BY_SCRIPT.items()}
    best = max(n, key=n.get)
    return best if n[best] else None


def plain(text: str, latin: bool) -> str:
    """Text without figures and, where case shows them, without names."""
    if latin and sum(1 for c in text if c.isupper()) <= 0.4 * len(text):
        text = _NAME.sub(" ", " " + text)
    return " ".join(_FIGURES.sub(" ", text).lower().split())


def _seeded(text: str) -> str | None:
    """Language of a sentence in Latin letters if its grammatical words leave no doubt."""
    words = [w.lower() for w in _WORD.findall(text)]
    n = {lang: sum(1 for w in words if w in seeds) for lang, seeds in _SEED_SETS.items()}
    (first, a), (_, b) = Counter(n).most_common(2)
    return first if a >= 3 and a >= 2 * b + 1 else None


def fit(texts: list[str], size: int = DICTIONARY) -> dict[tuple[str, str], bytes]:
    """(language, script) -> raw dictionary content. Text near the end is the nearest for the
    encoder, so the seeds stand there. Languages without an example get their seeds alone."""
    kept: dict[tuple[str, str], list[bytes]] = defaultdict(list)
    room: dict[tuple[str, str], int] = defaultdict(lambda: size)
    for text in texts:
        for a, b in sentences(text):
            s = text[a:b]
            kind = script(s)
            if kind is None or len(s) < (20 if kind == "latn" else 4):
                continue
            lang = _HOME.get(kind) or _seeded(s)
            if lang is None or room[lang, kind] <= 0:
                continue
            piece = (plain(s, kind == "latn") + " ").encode()
            kept[lang, kind].append(piece)
            room[lang, kind] -= len(piece)
    found = {(lang, "latn"): b"".join(kept.pop((lang, "latn"), [])) + " ".join(words).encode() for lang, words in _SEEDS.items()}
    return found | {key: b"".join(pieces) for key, pieces in kept.items()}


class Classifier:
    """Encoders over the dictionaries; one lives in each Python worker."""

    def __init__(self, content: dict[tuple[str, str], bytes]) -> None:
        self.encoders: dict[str, list[tuple[str, object]]] = defaultdict(list)
        self.all: list[tuple[str, object]] = []
        for (lang, kind), data in sorted(content.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.encoders[kind].append((lang, c))
            self.all.append((lang, c))

    def smallest(self, text: str, kind: str | None) -> tuple[str | None, float]:
        """(language, margin) of the encoding that is smallest, relative to the next language."""
        data = text.encode()
        n: dict[str, int] = {}
        for lang, c in self.encoders[kind] if kind else self.all:
            size = len(c.compress(data))
            n[lang] = min(size, n.get(lang, size))
        if not n:
            return None, 0.0
        ranked = sorted(n.items(), key=lambda x: (x[1], x[0]))
        return ranked[0][0], 1.0 if len(ranked) == 1 else 1 - ranked[0][1] / ranked[1][1]

    def parts(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of every sentence unit with letters; UNKNOWN where
        no dictionary fits."""
        units = []
        groups: dict[str, list[str]] = defaultdict(list)
        for a, b in sentences(text):
            kind = script(text[a:b])
            if kind:
                body = plain(text[a:b], kind == "latn")
                units.append([a, b, kind, body, None, 0.0])
                groups[kind].append(body)
        if not units:
            return []
        # a script without a dictionary goes to the one language that is written in it
        whole = {kind: self.smallest(" ".join(bodies), None) if self.encoders[kind] else (_HOME.get(kind), 0.0) for kind, bodies in groups.items()}
        whole = {kind: found if found[1] >= REJECT or not self.encoders[kind] else (UNKNOWN, found[1]) for kind, found in whole.items()}
        for u in units:
            lang, margin = whole[u[2]]
            if lang != UNKNOWN and len(groups[u[2]]) > 1 and len(self.encoders[u[2]]) > 1 and len(u[3]) >= 8:
                own, m = self.smallest(u[3], u[2])
                if own is not None and (m >= MARGIN or own == lang):
                    lang, margin = own, m
            u[4], u[5] = lang, margin
        return [(a, b, lang, 0.0 if lang == UNKNOWN else min(1.0, 0.5 + margin)) for a, b, _, _, lang, margin in units if lang]

    def record(self, text: str | None) -> tuple[str | None, float, list]:
        """(language, confidence, parts) of a whole record, None without letters."""
        parts = self.parts(text or "")
        size: Counter = Counter()
        sure: Counter = Counter()
        for a, b, lang, conf in parts:
            size[lang] += b - a
            sure[lang] += (b - a) * conf
        if not size:
            return None, 0.0, []
        total = sum(size.values())
        first, n = size.most_common(1)[0]
        second = (size.most_common(2)[1][1] if len(size) > 1 else 0) / total
        if second >= MIXED:
            return "mixed", sum(sure.values()) / total, parts
        return first, sure[first] / n * (1 - second), parts


def _fitted(df: DataFrame, sample: int) -> dict[tuple[str, str], bytes]:
    """The dictionaries, from the ``sample`` distinct texts of the smallest hashes, so that
    neither order nor files matter. A hash bound leaves little more than those to be sorted."""
    texts = df.select("text").where("length(text) > 0")
    share = min(1.0, 2.0 * sample / max(1, texts.count()))
    near = texts.withColumn("h", F.xxhash64("text")).where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else texts.withColumn("h", F.xxhash64("text"))
    rows = near.distinct().orderBy("h", "text").limit(sample).collect()  # bounded by ``sample``
    return fit([r.text for r in rows])


def languages(df: DataFrame, item_id: str, text: str, label: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of df: (item_id, label, language, confidence, parts), parts being
    (start, end, language, confidence) of the sentence units with letters.

    language is a code, or ``mixed`` where a second language fills at least MIXED of the
    letters' units, ``und`` with confidence 0 where no language's dictionary fits; null with
    confidence 0 and no parts for null, empty and letterless texts. Repeated rows are repeated. An empty table gives no rows. The dictionaries are
    fitted on at most ``sample`` records, chosen by a hash of their text. Other columns are
    not read.
    """
    kind = df.schema[item_id].dataType.simpleString()
    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    content = df.sparkSession.sparkContext.broadcast(_fitted(rows, sample))
    part = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(content.value)
        for b in batches:
            found = [own.record(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([[dict(zip(("start", "end", "language", "confidence"), p)) for p in x[2]] for x in found], part),
                ],
                ["item_id", "label", "language", "confidence", "parts"],
            )

    out = f"item_id {kind}, label string, language string, confidence double, parts array<struct<start:int,end:int,language:string,confidence:double>>"
    return spread(rows).mapInArrow(run, out)


def _chunks(spark, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "chunks", "chunk_id", "text", "language"), "chunk_id", "text", "language")


def found(spark, sf_dir: str) -> DataFrame:
    wrong = _chunks(spark, sf_dir).where("language is not null and language <> 'und' and (label is null or label <> language)")
    return wrong.select(F.col("item_id").alias("chunk_id"), "language").distinct()


def parts(spark, sf_dir: str) -> DataFrame:
    """The parts of mixed chunks, neighbours of one language joined by their unit order."""
    mixed = _chunks(spark, sf_dir).where("language = 'mixed'").select(F.col("item_id").alias("chunk_id"), F.posexplode("parts").alias("part", "p"))
    return mixed.select("chunk_id", "part", "p.start", "p.end", "p.language", F.round("p.confidence", 3).alias("confidence")).distinct()
