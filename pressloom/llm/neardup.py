"""Problem 6: records that share most of their content.

A prefix-tree join on sets of word n-grams, exact for its threshold. Texts with one set of
n-grams are one class, so copies are never compared. Over the classes the n-grams get one
global order, rarest first. An n-gram that only one class holds can join nothing, so only
the shared ones are kept after a single shuffle; how many were left out is all that is
needed to place the rest.

The ordered sets are stored in tries, each set in one of them. Sets whose beginnings share
n-grams get one label and so one trie; the trie of a label with too many sets is split by
salt. A set visits the tries that hold one of the n-grams of its own beginning where lengths
and positions leave enough room: it enters each at the nodes where the first common n-gram
stands, sets with a common beginning sharing their partial overlap from there on, and leaves
every subtree whose remaining length cannot reach the overlap that is needed. No pairs of
sets are made before the walk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.session import cut_lineage, sized_partitions, spread
from pressloom.sources.tables import table

GRAM, SIMILAR = 5, 0.8
#: n-grams stored in one trie, about.
TRIE = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EPS = 1e-9


class _Hashes(dict):
    """Word -> 64-bit hash, forgotten when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


#: Scripts that write no spaces; each of their characters is a word of its own.
_SPACELESS = r"぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿\U00020000-\U0003ffff"
_ANY = re.compile(f"[{_SPACELESS}]")
_PIECES = re.compile(rf"[{_SPACELESS}]|[^\s{_SPACELESS}]+")


def tokens(text: str) -> list[str]:
    """Lower-cased words; characters where the script has no spaces."""
    low = text.lower()
    return _PIECES.findall(low) if _ANY.search(low) else low.split()


def gram_set(text: str | None, gram: int, hashes: dict, spaceless: bool = False) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``gram`` words. Shorter texts have none, but with
    ``spaceless`` all their words make one run."""
    ws = (tokens(text) if spaceless else text.lower().split()) if text else []
    if spaceless and 0 < len(ws) < gram:
        gram = len(ws)
    m = len(ws) - gram + 1
    if m < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            out = (out ^ (out >> np.uint64(29))) * _A + h[k : k + m] * _B
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _class_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def classes(df: DataFrame, item_id: str, text: str, gram: int, spaceless: bool = False) -> DataFrame:
    """(item_id, class_id, n): every item with at least one n-gram, its class, and how many."""
    kind = df.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            at, ids, ns = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                g = gram_set(t, gram, hashes, spaceless)
                if g.size:
                    at.append(i)
                    ids.append(_class_id(g))
                    ns.append(g.size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(ns, pa.int32())], ["item_id", "class_id", "n"])

    return _source(df, item_id, text).mapInArrow(run, f"item_id {kind}, class_id bigint, n int")


def _source(df: DataFrame, item_id: str, text: str) -> DataFrame:
    return spread(df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null"))


def _grams(df: DataFrame, item_id: str, text: str, gram: int, spaceless: bool = False) -> DataFrame:
    """(gram, class_id, n), each class once for every partition that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for b in batches:
            grams, ids, sizes = [np.empty(0, np.uint64)], [], []
            for t in b.column(0).to_pylist():
                g = gram_set(t, gram, hashes, spaceless)
                if g.size and (c := _class_id(g)) not in seen:
                    seen.add(c)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    grams.append(g)
                    ids.append(c)
                    sizes.append(g.size)
            n = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.repeat(n, n).astype(np.int32))], ["gram", "class_id", "n"]
            )

    return _source(df, item_id, text).select("text").mapInArrow(run, T.StructType([T.StructField("gram", T.LongType(), False), T.StructField("class_id", T.LongType(), False), T.StructField("n", T.IntegerType(), False)]))


def _ordered(grams: DataFrame, similar: float, parts: int) -> DataFrame:
    """(class_id, n, grams, reach): the shared n-grams of a class in the global order, and how
    many of them lie in its prefix. Classes whose prefix holds only n-grams of their own are
    left out, as nothing can join them."""
    # One exchange serves the counts and the join, as both sides read all its columns.
    grams = grams.repartition(parts, "gram")
    by_gram = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.max("n").alias("most"))
    shared = by_gram.where("lo < hi and most > 0").select("gram", "df")
    kept = grams.join(shared.hint("shuffle_hash"), "gram")
    # plain rows travel, as there is next to nothing to aggregate before
    own = kept.select("class_id", "n", F.col("df").cast("int").alias("df"), "gram").repartition(parts, "class_id").groupBy("class_id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "gram"))).alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(similar) - F.lit(_EPS)) + 1
    return (
        own.select("class_id", "n", F.col("s.gram").alias("grams"), (prefix - (F.col("n") - F.size("s"))).cast("int").alias("reach"))
        .where("reach > 0")
        .withColumn("skipped", F.col("n") - F.size("grams"))
    )


class Trie:
    """Ordered sets, common beginnings stored once. For every node its n-gram, its parent, its
    children, the greatest length left below it and the sets that end there; and for every
    n-gram of a beginning the nodes where it stands."""

    def __init__(self) -> None:
        self.gram: list = [None]
        self.parent: list[int] = [0]
        self.most: list[int] = [0]
        self.kids: list[dict] = [{}]
        self.ends: list[list | None] = [None]
        self.entries: dict = {}

    def add(self, key, grams: list, total: int, zone: int) -> None:
        """Store a set under its key; the first ``zone`` n-grams are its beginning, and total
        counts all its n-grams."""
        node, left = 0, len(grams)
        for k, g in enumerate(grams):
            self.most[node] = max(self.most[node], left)
            nxt = self.kids[node].get(g)
            if nxt is None:
                nxt = self.kids[node][g] = len(self.gram)
                self.gram.append(g)
                self.parent.append(node)
                self.most.append(0)
                self.kids.append({})
                self.ends.append(None)
            if k < zone:
                self.entries.setdefault(g, {})[nxt] = True
            node, left = nxt, left - 1
        if self.ends[node] is None:
            self.ends[node] = []
        self.ends[node].append((key, total))

    def join(self, key, grams: list, total: int, reach: int, similar: float) -> Iterator[tuple]:
        """(key, similarity) of every stored set that is similar enough and that is shorter
        than the visitor, or as long with a smaller key."""
        least = ceil(total * similar - _EPS)
        place = {g: i for i, g in enumerate(grams)}
        size = len(grams)
        for i, g in enumerate(grams[:reach]):
            for entry in self.entries.get(g, ()):
                up = self.parent[entry]
                while up and self.gram[up] not in place:
                    up = self.parent[up]
                if up:  # the walk that began there comes through here
                    continue
                stack = [(entry, 1, i + 1)] if 1 + min(self.most[entry], size - i - 1) >= least else []
                while stack:
                    node, overlap, after = stack.pop()
                    for other, n in self.ends[node] or ():
                        union = total + n - overlap
                        if (n, other) < (total, key) and overlap >= similar * union - _EPS:
                            yield other, overlap / union
                    for c, child in self.kids[node].items():
                        at = place.get(c)
                        o, p = (overlap, after) if at is None else (overlap + 1, at + 1)
                        # what this branch and the rest of the visitor can still add
                        if o + min(self.most[child], size - p) >= least:
                            stack.append((child, o, p))


def _stored(ordered: DataFrame, similar: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """(tries, visits): tries (label, salt, class_id, n, grams, zone) places every set that can
    be the shorter of a pair and that somebody visits; visits (label, salt, class_id) are the
    tries each set must see. A trie's doors are the n-grams of its sets' beginnings, each with
    the lengths behind it; one too short for a set or too far in is not entered."""
    share = similar / (1 + similar)
    zone = (F.col("n") - F.ceil(F.col("n") * F.lit(2 * share) - F.lit(_EPS)) + 1 - F.col("skipped")).cast("int")
    # the least hash of a beginning: alike for sets that are alike, and known without a shuffle
    label = F.when(F.col("zone") > 0, F.array_min(F.transform(F.slice("grams", 1, F.col("zone")), lambda g: F.xxhash64(g))))
    placed = ordered.withColumn("zone", zone).withColumn("label", label)
    rows = placed.select("class_id", "n", "skipped", "zone", "label", F.posexplode(F.slice("grams", 1, F.col("reach"))).alias("k", "gram")).select(
        "gram", "class_id", F.when(F.col("k") < F.col("zone"), F.col("label")).alias("label"), "n", (F.col("n") - F.col("k") - F.col("skipped")).alias("room")
    )
    rows = rows.repartition(parts, "gram")  # one exchange for both sides
    doors = rows.where("label is not null").groupBy("gram", "label").agg(F.max("room").alias("far"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets"), F.min("class_id").alias("one"))
    needed = F.ceil((F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * F.lit(similar) - F.lit(_EPS)))) * F.lit(share) - F.lit(_EPS))
    seen = (
        rows.select("gram", "class_id", "n", "room").hint("shuffle_hash").join(doors, "gram")
        .where("(sets > 1 or one <> class_id) and least <= n")
        .where((F.col("most") >= F.col("n") * F.lit(similar) - F.lit(_EPS)) & (F.least("far", "room") >= needed))
        .select("label", "class_id").distinct()
    )
    seen = cut_lineage(seen)
    asked = seen.select("label").distinct()
    held = placed.where("zone > 0").join(asked, "label", "left_semi")
    pieces = held.groupBy("label").agg(F.ceil(F.sum(F.size("grams")) / F.lit(TRIE)).cast("int").alias("pieces"))
    tries = held.join(pieces, "label").select("label", F.pmod(F.xxhash64("class_id"), F.col("pieces")).cast("int").alias("salt"), "class_id", "n", "grams", "zone")
    visits = seen.join(pieces, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt"), "class_id")
    return tries, visits


def _walk(ordered: DataFrame, tries: DataFrame, visits: DataFrame, similar: float, parts: int) -> DataFrame:
    """(a, b, similarity) of the pairs of classes above the threshold."""
    stored = tries.select("label", "salt", F.lit(0).alias("turn"), "class_id", "n", "grams", F.col("zone").alias("most"))
    coming = visits.join(ordered.select("class_id", "n", "grams", F.col("reach").alias("most")), "class_id").select("label", "salt", F.lit(1).alias("turn"), "class_id", "n", "grams", "most")
    # the sets of one trie come first, then its visitors
    rows = stored.unionByName(coming).repartition(parts, "label", "salt").sortWithinPartitions("label", "salt", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(7)]
            heads = [c.to_pylist() for c in columns[:5]]
            for i, (label, salt, turn, key, n) in enumerate(zip(*heads)):
                grams, most = columns[5][i].as_py(), columns[6][i].as_py()
                if (label, salt) != now:
                    now, trie = (label, salt), Trie()
                if not turn:
                    trie.add(key, grams, n, most)
                else:
                    out.extend((other, key, s) for other, s in trie.join(key, grams, n, most, similar))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return rows.mapInArrow(run, "a bigint, b bigint, similarity double")


def links(df: DataFrame, item_id: str, text: str, gram: int = GRAM, similar: float = SIMILAR, spaceless: bool = True) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership (item_id, class_id, n) holds every item with a word;
    links (a, b, similarity) holds every pair of different classes whose sets have
    |intersection| / |union| >= similar. Items of one class are copies, of similarity 1.

    Scripts without spaces count by characters, and a text of fewer than ``gram`` words is
    one n-gram, so that copies of it meet; without ``spaceless`` words are split on white
    space only and such texts are in no class. Null and blank texts and null ids are in no
    class. Repeated rows give repeated membership. An empty table gives two empty results.
    Other columns are not read. Classes are told apart by a hash of 64 bits, n-grams likewise.
    """
    parts = sized_partitions(df)
    ordered = cut_lineage(_ordered(_grams(df, item_id, text, gram, spaceless), similar, parts))
    tries, visits = _stored(ordered, similar, parts)
    return classes(df, item_id, text, gram, spaceless), _walk(ordered, tries, visits, similar, parts)


def item_pairs(df: DataFrame, item_id: str, text: str, gram: int, similar: float, spaceless: bool = False) -> DataFrame:
    """Every pair of different items above the threshold, copies expanded."""
    member, link = links(df, item_id, text, gram, similar, spaceless)
    member = member.select("item_id", "class_id").distinct()
    crowd = member.groupBy("class_id").agg(F.count("*").alias("members")).where("members > 1")
    within = member.join(crowd, "class_id").select("item_id", F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    same = within.select("a", F.col("item_id").alias("x")).join(within.select("a", F.col("item_id").alias("y")), "a").where("x < y")
    across = (
        link.select("a", "b")
        .join(member.select(F.col("class_id").alias("a"), F.col("item_id").alias("x")), "a")
        .join(member.select(F.col("class_id").alias("b"), F.col("item_id").alias("y")), "b")
        .where("x <> y")
    )
    both = same.select("x", "y").unionByName(across.select("x", "y"))
    return both.select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b")).distinct()


def found(spark, sf_dir: str) -> DataFrame:
    pairs = item_pairs(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text", 3, 0.6)
    return pairs.select(F.col("item_id_a").alias("chunk_id_a"), F.col("item_id_b").alias("chunk_id_b"))


def linked(spark, sf_dir: str) -> DataFrame:
    """One row per chunk (word 5-grams, 0.8): class, number of copies, number of linked classes."""
    member, link = links(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text")
    degree = link.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    member = member.select("item_id", "class_id").distinct()
    copies = member.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    return member.join(copies.join(degree, "class_id", "left"), "class_id").select(F.col("item_id").alias("chunk_id"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
