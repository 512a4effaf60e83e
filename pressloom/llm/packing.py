"""Problem 8: documents packed into containers of one fixed capacity.

Sizes are tokens of a public tokenizer. Documents above the capacity are cut into full
containers and a rest; nothing else is cut. The rest goes into windows of bounded size, by
hash, and each window is partitioned by Karmarkar-Karp multiway differencing: the two
partial partitions with the greatest imbalance are merged so that their imbalances oppose
each other, until one is left. It starts with the least number of containers that can hold
the window and takes one more whenever a container would be too full.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut_lineage, partitions, spread
from pressloom.sources.tables import table

CAPACITY = 4096
#: Containers and items that one window holds on average.
WINDOW_CONTAINERS, WINDOW_ITEMS = 128, 2000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a rank file, loaded once in a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def differencing(sizes: list[int], k: int) -> list[int]:
    """Part of each item in a partition into k parts by multiway differencing."""
    left: list[int] = [-1] * len(sizes)  # a node is an item, or joins two nodes
    right: list[int] = [-1] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        nodes = np.full(k, -1, np.int64)
        nodes[0] = i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, nb = a + b[::-1], nb[::-1]
        nodes = np.where(na < 0, nb, na)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        for j, x, y in zip(both.tolist(), na[both].tolist(), nb[both].tolist()):
            nodes[j] = len(left)
            left.append(x)
            right.append(y)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), turn, sums, nodes))
        turn += 1
    part = [0] * len(sizes)
    if heap:
        for j, node in enumerate(heap[0][3].tolist()):
            stack = [node]
            while stack:
                n = stack.pop()
                if n < 0:
                    continue
                if n < len(sizes):
                    part[n] = j
                else:
                    stack += [left[n], right[n]]
    return part


def fill(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item, none over the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        part = differencing(sizes, k)
        load = np.bincount(part, weights=sizes, minlength=k) if sizes else np.zeros(1)
        if load.max() <= capacity:
            return part
        k += 1


def sized(docs: DataFrame, doc_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text with tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in batches:
            n = [len(own.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return spread(rows).mapInArrow(run, f"doc_id {kind}, n_tokens bigint").where("n_tokens > 0")


def packed(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, container_id): where every document lies.

    start is the first token of the piece in its document; a document within the capacity
    is one piece. Null and empty texts have no row. Repeated rows are items of their own. A
    null id is an item too. An empty table gives no rows. Other columns are not read.
    """
    # the row number tells repeated rows apart
    items = cut_lineage(sized(docs, doc_id, text, path).withColumn("row", F.monotonically_increasing_id()))
    kind = items.schema["doc_id"].dataType
    cut = items.select("doc_id", "row", "n_tokens", F.posexplode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("bigint"))).alias("piece", "k")).select(
        "doc_id", "row", "piece", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("k") * capacity).alias("size")
    )
    total = items.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    windows = max(1, -(-(total.t or 0) // (capacity * WINDOW_CONTAINERS)), -(-total.n // WINDOW_ITEMS))
    rows = cut.withColumn("window", F.when(F.col("size") == capacity, F.lit(-1)).otherwise(F.pmod(F.xxhash64("row", "piece"), F.lit(windows))).cast("bigint"))
    whole = rows.where("window = -1").select("doc_id", "piece", "start", F.col("size").alias("n_tokens"), F.concat_ws("-", F.lit("f"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("container_id"))
    rest = rows.where("window >= 0").select("doc_id", "piece", "start", "size", "window", "row").repartition(min(windows, partitions(docs.sparkSession)), "window").sortWithinPartitions("window", F.desc("size"), "row", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            part = fill(t.column("size").to_pylist(), capacity)
            names = pa.array([f"w{now}-{p}" for p in part])
            yield from pa.table([t.column("doc_id"), t.column("piece"), t.column("start"), t.column("size"), names], ["doc_id", "piece", "start", "n_tokens", "container_id"]).to_batches()

        for b in batches:
            w = b.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
            for x, y in zip(edges, edges[1:]):
                if y > x:
                    if now is not None and w[x] != now:
                        yield from done()
                        held.clear()
                    now = int(w[x])
                    held.append(b.slice(x, y - x))
        if now is not None:
            yield from done()

    out = f"doc_id {kind.simpleString()}, piece int, start bigint, n_tokens bigint, container_id string"
    return rest.mapInArrow(run, out).unionByName(whole)


def containers(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def loads(spark, sf_dir: str) -> DataFrame:
    """Load of every container."""
    return containers(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / CAPACITY, 4).alias("share"))
