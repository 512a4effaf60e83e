"""Problem 9: passages of evaluation items inside a corpus.

A prefix-filtered set join, of all items at once. The sets are the windows of N consecutive
words of the items, the tokens their pairs of neighbouring words. As all pairs of a window
must occur, its necessary prefix is one pair, and the rarest one by document frequency in
the corpus selects least. Documents give the places of pairs that are in some prefix, with
the N - 2 words on both sides; the join with the items' places fixes how item and document
lie against each other, and comparing the words around counts the run exactly. Runs that
overlap on one alignment are one run, so passages of any length are measured whole.

Which pairs matter is told to the executors by a bitmap of bounded size, never by a list: a
pair that is in it by chance is dropped by the join. A pair that a great part of the corpus
holds is split over salts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut_lineage, spread
from pressloom.sources.tables import table

WORDS = 12
#: Fewest words of an item that is looked for whole because it has no window.
SHORT = 5
#: Bits of a bitmap for one pair, and bounds of its size: at most 32 MB.
BITS, LEAST, MOST = 16, 1 << 18, 1 << 28
SALTS = 8
_DROPPED = regex.compile(r"[^\p{L}\p{M}\p{N}\s]+")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")
_ANY = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None, spaceless: bool = False) -> list[str]:
    """Lower-cased words of letters, combining marks and numbers only; with ``spaceless`` the
    characters of scripts without spaces are words."""
    if not text:
        return []
    plain = _DROPPED.sub("", text.lower())
    return _SPACELESS.findall(plain) if spaceless and _ANY.search(plain) else plain.split()


class _Hashes(dict):
    """Word -> 64-bit hash, forgotten when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) | 2  # 0 and 1 stand for no word
        return h


def hashed(ws: list[str], hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        return ((h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX + h[1:]).view(np.int64)


def around(h: np.ndarray, at: np.ndarray, n: int, none: int) -> np.ndarray:
    """The words from n - 2 before to n - 2 behind each pair, ``none`` outside the text."""
    padded = np.concatenate([np.full(n - 2, none, np.uint64), h, np.full(n - 2, none, np.uint64)])
    return padded[at[:, None] + np.arange(2 * n - 2)]


def _bitmap(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bitmap of a one-column table of hashes, as bytes, and the number of its bits."""
    bits = min(MOST, max(LEAST, 1 << (BITS * max(count, 1) - 1).bit_length()))
    slot = keys.select(F.expr(f"pmod(k, {bits})").alias("s"))
    found = slot.groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m")).collect()  # bits / 8 bytes at most
    # buckets count from 1 and their positions from 0, slot 0 being the last of bucket 0
    flat = np.zeros(bits // 8 + 2 * 4096, np.uint8)
    for r in found:
        flat[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.m, np.uint8)
    return flat, bits


def _inside(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    s = np.mod(keys, bits)
    # as Spark numbers them: bucket 1 + (s - 1) / 32768, position (s - 1) % 32768; 0 has bucket 0, position 0
    bucket = np.where(s > 0, 1 + (s - 1) // 32768, 0)
    place = np.where(s > 0, (s - 1) % 32768, 0)
    at = bucket * 32768 + place
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _prefixes(n: int):
    """For each item, the places of the rarest pair of every window, with what lies around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, item, at, ctx, size = [], [], [], [], []
            for i, (ws, freq) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                h = np.array(ws, np.int64).view(np.uint64)
                p = pairs(h)
                f = np.array(freq, np.int64)
                m = min(n, len(h)) - 1  # pairs of a window
                found = set()
                for k in range(len(p) - m + 1):
                    part = f[k : k + m]
                    if part.min() > 0:
                        found.add(k + int(part.argmin()))
                if found:
                    where = np.array(sorted(found))
                    keys.append(p[where])
                    item += [i] * len(where)
                    at += where.tolist()
                    ctx += [x.tobytes() for x in around(h, where, n, 1)]
                    size += [len(h)] * len(where)
            k = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), b.column(0).take(pa.array(item, pa.int64())), pa.array(at, pa.int32()), pa.array(ctx, pa.binary()), pa.array(size, pa.int32())], ["k", "item", "at", "i_ctx", "size"]
            )

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = WORDS, spaceless: bool = False, short: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, n_words, share): documents that share at least n consecutive
    words with an item, the longest such run, and its share of the item's words.

    With ``spaceless`` characters count as words in scripts without spaces. With ``short``
    items of at least so many but fewer than n words are found where they stand whole; else
    they have no rows. Null or blank texts and passages and null ids have no rows. Repeated
    documents, and repeated items of one id, count as one, the longest run counting. Empty
    tables give no rows. Other columns are not read. Words are told apart by 64-bit hashes.
    """
    if n < 3:
        raise ValueError("n must be at least 3")
    fewest = n if short is None else max(2, min(short, n))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    asked = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).where("passage is not null and item_id is not null").distinct()
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    sc = docs.sparkSession.sparkContext

    def hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Hashes()
        for b in batches:
            hs = [hashed(words(t, spaceless), own) for t in b.column(1).to_pylist()]
            at = [i for i, h in enumerate(hs) if len(h) >= fewest]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([hs[i].view(np.int64) for i in at], pa.list_(pa.int64())), pa.array([pairs(hs[i]) for i in at], pa.list_(pa.int64()))], ["item_id", "h", "p"])

    known = cut_lineage(asked.mapInArrow(hash_items, f"item_id {item_type}, h array<bigint>, p array<bigint>").withColumn("item", F.monotonically_increasing_id()))
    placed = known.select("item", F.posexplode("p").alias("at", "k"))
    wanted = placed.select("k").distinct()
    bitmap, bits = _bitmap(wanted, wanted.count())
    first = sc.broadcast(bitmap)  # at most 32 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = _Hashes(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["k", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                p = pairs(hashed(words(t, spaceless), own))
                seen.update(np.unique(p[_inside(first.value, bits, p)]).tolist())
            if len(seen) > 1_000_000:
                yield rows()
                seen.clear()
        yield rows()

    frequency = spread(source.select("text")).mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    counted = placed.join(frequency, "k", "left").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("freq"))
    rows = known.select("item", "h").join(counted, "item")
    prefix = cut_lineage(rows.mapInArrow(_prefixes(n), "k bigint, item bigint, at int, i_ctx binary, size int"))
    needed = prefix.select("k").distinct()
    bitmap2, bits2 = _bitmap(needed, needed.count())
    second = sc.broadcast(bitmap2)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Hashes()
        for b in batches:
            docs_, keys, pos, ctx = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                h = hashed(words(t, spaceless), own)
                p = pairs(h)
                at = np.flatnonzero(_inside(second.value, bits2, p))
                if at.size:
                    docs_ += [i] * len(at)
                    keys.append(p[at])
                    pos += at.tolist()
                    ctx += [x.tobytes() for x in around(h, at, n, 0)]
            k = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column(0).take(pa.array(docs_, pa.int64())), pa.array(pos, pa.int32()), pa.array(ctx, pa.binary())], ["k", "doc_id", "pos", "d_ctx"])

    hits = spread(source).mapInArrow(places, f"k bigint, doc_id {doc_type}, pos int, d_ctx binary").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = prefix.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = hits.join(salted, ["k", "salt"]).select("doc_id", "item", "pos", "at", "size", "d_ctx", "i_ctx")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * n - 2
        for b in batches:
            joined = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, width) for i in (5, 6)]
            same = joined[0] == joined[1]
            left = np.cumprod(same[:, : n - 2][:, ::-1], axis=1).sum(1)
            right = np.cumprod(same[:, n:], axis=1).sum(1)
            pos, at, size = (b.column(i).to_numpy() for i in (2, 3, 4))
            keep = np.flatnonzero(same[:, n - 2] & same[:, n - 1] & (left + right + 2 >= np.minimum(n, size)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array((pos - at)[keep].astype(np.int32)), pa.array((pos - left)[keep].astype(np.int32)), pa.array((pos + 2 + right)[keep].astype(np.int32)), pa.array(size[keep])],
                ["doc_id", "item", "turn", "a", "z", "size"],
            )

    runs = met.mapInArrow(compare, f"doc_id {doc_type}, item bigint, turn int, a int, z int, size int").distinct()
    zero = F.struct(F.lit(0).alias("best"), F.lit(-1).alias("a"), F.lit(-1).alias("z"))

    def grow(acc, x):
        on = x["a"] <= acc["z"]
        a, z = F.when(on, acc["a"]).otherwise(x["a"]), F.when(on, F.greatest(acc["z"], x["z"])).otherwise(x["z"])
        return F.struct(F.greatest(acc["best"], z - a).alias("best"), a.alias("a"), z.alias("z"))

    # the runs of one alignment, no more than the item has words
    whole = runs.groupBy("doc_id", "item", "turn", "size").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("a", "z"))), zero, grow, lambda acc: acc["best"]).alias("n_words"))
    best = whole.groupBy("doc_id", "item").agg(F.max("n_words").alias("n_words"), F.max(F.col("n_words") / F.col("size")).alias("share"))
    return best.join(known.select("item", "item_id"), "item").groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("share").alias("share"))


def report(spark, sf_dir: str) -> DataFrame:
    """Every leaking document with its items and how much of each it holds; characters are
    words where a script has no spaces, and short items are found whole."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "eval_items", "item_id", "passage")
    return leaks(docs, "doc_id", "text", items, "item_id", "passage", spaceless=True, short=SHORT)


def found(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "eval_items", "item_id", "passage")
    return leaks(docs, "doc_id", "text", items, "item_id", "passage").select("doc_id", "item_id").distinct()


def items_leaked(spark, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it, whole and in part."""
    return report(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("share") == 1.0).alias("n_whole"), F.max("n_words").alias("longest")
    )
