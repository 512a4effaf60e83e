"""Ranked retrieval: lexical and vector legs, fusion, re-ranking, duplicates, diversity.

Questions come in batches: every operator takes a table of questions and keeps qid through,
so one plan serves one question or a million. Ties end at the chunk id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.session import cut_lineage, partitions

RRF_K, OVERFETCH, PER_FILE = 60, 4, 2
K1, B = 1.2, 0.75
#: Questions from which on they are ranked by the terms they share; cells of the filter of asked terms.
BATCH, BUCKETS = 1024, 1 << 20
#: Fixed: how much each kind of source weighs for each intent of a question.
PRIORS = {
    "documentary": {"source_doc": 1.06, "press_release": 1.00, "news_clip": 1.00, "video": 1.00, "slide": 1.00, "table": 0.96},
    "attribution": {"press_release": 1.08, "video": 1.06, "news_clip": 1.04, "slide": 1.03, "source_doc": 0.96, "table": 0.94},
    "general": {"press_release": 1.03, "video": 1.03, "news_clip": 1.02, "slide": 1.02, "source_doc": 0.98, "table": 0.96},
}
OTHER_PRIOR, COVERAGE_WEIGHT = 0.90, 0.0015
#: Fixed: words that ask what somebody said, and words that ask for a document.
ATTRIBUTION = r"(?i)\b(?:said|say|statement|statements|allege|alleged|allegations|criticise|criticized|response|respond)\b|అన్నారు|చెప్పారు|ఆరోపణ|విమర్శ"
DOCUMENTARY = r"(?i)\b(?:court|supreme court|sit|cag|report|order|verdict|conclude|concluded|document|tariff filing)\b|కోర్టు|నివేదిక|తీర్పు"


def ranked(df: DataFrame, k: int, *order: Column, by: str = "qid") -> DataFrame:
    """The first k rows of each question as rank 1..k; the group limit runs before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(term, chunk_id, tf, dl): the inverted index of a table with chunk_id, once per id."""
    # a fixed number of partitions, as few bytes of text are much work
    rows = chunks.select("chunk_id", F.col(text).alias("text")).repartition(partitions(chunks.sparkSession), "chunk_id")
    once = rows.groupBy("chunk_id").agg(F.min("text").alias("text")).where("text is not null")
    terms = once.select("chunk_id", S.words(F.col("text")).alias("ws")).withColumn("dl", F.size("ws")).where("dl > 0")
    return terms.select("chunk_id", "dl", F.explode("ws").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def with_frequencies(index: DataFrame) -> DataFrame:
    """An inverted index by term with the number of chunks of each, for one that is written."""
    return index.repartition("term").withColumn("df", F.count("*").over(Window.partitionBy("term")))


def index_stats(index: DataFrame) -> DataFrame:
    """One row (n, avgdl) over an inverted index: chunks and their mean number of words."""
    return index.groupBy("chunk_id").agg(F.sum("tf").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(index: DataFrame, questions: DataFrame, k: int, stats: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best chunks of each question (qid, q) by BM25 over
    its distinct terms. The index serves the statistics, the document frequencies and the
    scores and is best one that was written (session.kept), as are its statistics; only
    postings of asked terms are scored. More than ``batch`` questions go by their shared terms."""
    stats = index_stats(index) if stats is None else stats
    asked = questions.select("qid", F.explode(S.query_terms(F.col("q"))).alias("term"))
    many = questions.limit(batch + 1).count() > batch
    if many:  # a filter of fixed size, so that only asked postings are moved
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("_b")
        index = index.select("*", bucket).join(F.broadcast(asked.select(bucket).distinct()), "_b", "left_semi").drop("_b")
    wanted = index.join(asked.groupBy("term").agg(F.count("*").alias("qf")), "term")
    if "df" not in index.columns:
        wanted = wanted.join(wanted.groupBy("term").agg(F.count("*").alias("df")), "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    pairs = F.col("qf") * F.col("df")
    level = F.when(pairs > F.col("n"), 2).when(pairs * 16 > F.col("n"), 1).otherwise(0)
    weights = wanted.crossJoin(F.broadcast(stats)).select("term", "chunk_id", (idf * tf).alias("w"), level.alias("level"))  # stats is one row
    if many:
        return _shared(weights, asked, k)
    scored = asked.join(weights, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return ranked(scored, k, F.desc("score"), F.col("chunk_id"))


def numbered(df: DataFrame) -> DataFrame:
    """Rows with ``doc``, a number in the order of their chunk_id. It has to be written before
    it is read twice."""
    return df.orderBy("chunk_id").withColumn("doc", F.monotonically_increasing_id())


def _shared(weights: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What bm25 returns, for many questions with terms in common.

    A question's terms come in levels, those that make most pairs of a question and a chunk
    first. All questions with the same terms of a level share its scores. A chunk with none
    of the rarer terms is among a question's k best only if it is among the k best by the
    terms before, as weights are positive; so only chunks that hold a rarer term, and those
    k, are scored for the rarer terms."""
    docs = cut_lineage(numbered(weights.select("chunk_id").distinct()))
    w = cut_lineage(weights.join(docs, "chunk_id").select("term", "doc", "w", "level"))
    known = asked.join(w.groupBy("term").agg(F.max("level").alias("level")), "term")
    of = lambda level: F.array_sort(F.collect_set(F.when(F.col("level") == level, F.col("term"))))
    sets = known.groupBy("qid").agg(of(2).alias("h2"), of(1).alias("h1"), of(0).alias("h0"))
    sets = cut_lineage(sets.select("qid", F.xxhash64("h2").alias("g2"), F.xxhash64("h2", "h1").alias("g1"), "h2", "h1", "h0"))

    def scores(by: list[str], terms: str, name: str) -> DataFrame:
        own = sets.select(*by, F.explode(terms).alias("term")).distinct()
        return own.join(w.select("term", "doc", "w"), "term").groupBy(*by, "doc").agg(F.sum("w").alias(name))

    def best(rows: DataFrame, by: str, *more: str) -> DataFrame:
        once = rows.groupBy(by, *more, "doc").agg(F.round(F.max("score"), 6).alias("r"), F.max("score").alias("score"))
        return ranked(once, k, F.desc("r"), F.col("doc"), by=by)

    total = lambda *names: sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.col(names[0])).alias("score")
    s2, s1, s0 = scores(["g2"], "h2", "s2"), scores(["g1", "g2"], "h1", "s1"), scores(["qid", "g1", "g2"], "h0", "s0")
    top2 = best(s2.select("g2", "doc", F.col("s2").alias("score")), "g2").select("g2", "doc", "score")
    rows1 = s1.join(s2, ["g2", "doc"], "left").select("g1", "doc", total("s1", "s2"))
    top1 = best(rows1.unionByName(sets.select("g1", "g2").distinct().join(top2, "g2").select("g1", "doc", "score")), "g1").select("g1", "doc", "score")
    rows0 = s0.join(s1.select("g1", "doc", "s1"), ["g1", "doc"], "left").join(s2, ["g2", "doc"], "left").select("qid", "doc", total("s0", "s1", "s2"))
    top0 = best(rows0.unionByName(sets.select("qid", "g1").join(top1, "g1").select("qid", "doc", "score")), "qid")
    return top0.join(docs, "doc").select("qid", "chunk_id", F.col("r").alias("score"), "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def check_dimension(vectors: DataFrame, queries: DataFrame) -> int:
    """The one dimension of both tables; a mismatch raises, naming both."""
    span = lambda df: df.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    dims, asked = ([x for x in dict.fromkeys(span(df)) if x is not None] for df in (vectors, queries))
    if len(dims) > 1 or len(asked) > 1 or (dims and asked and dims != asked):
        raise ValueError(f"vectors have dimension {dims}, queries {asked}")
    return (dims or asked or [0])[0]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 65536) -> DataFrame:
    """(qid, chunk_id, score, rank): exact cosine neighbours of stated queries (qid, vector)
    among all rows (chunk_id, vector, and doc where they are ``numbered``). Equal queries are
    looked up once. They come in blocks sent to the executors; of each task only the k best of
    each query leave it."""
    import numpy as np
    import pyarrow as pa

    same = queries.groupBy("vector").agg(F.min("qid").alias("head"))
    rows = same.select("head", "vector").orderBy("head")
    first = rows.limit(block + 1).toArrow()  # one block of the stated queries, and whether there are more
    total, spark, result = len(first) if len(first) <= block else rows.count(), vectors.sparkSession, None
    placed = rows.select("*", F.row_number().over(Window.orderBy("head")).alias("_n")) if total > block else rows
    stated = vectors.where("vector is not null").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    own = stated if "doc" in vectors.columns else cut_lineage(numbered(stated.select("chunk_id", "vector")))
    for start in range(0, max(total, 1), block):
        held = first if total <= block else placed.where(F.col("_n").between(start + 1, start + block)).select("head", "vector").toArrow()
        flat = held.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shipped = spark.sparkContext.broadcast((held.column("head").to_numpy(), flat.reshape(len(held), -1) if len(held) else flat.reshape(0, 0)))

        def run(batches, shipped=shipped):
            heads, q = shipped.value
            search = Nearest(q, k)
            for b in batches:
                if len(heads) and b.num_rows:
                    search.add(b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            at, docs, scores = search.found()
            for i in range(0, len(at), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(heads[at[part]], pa.int64()), pa.array(docs[part], pa.int64()), pa.array(scores[part], pa.float64())], ["head", "doc", "score"])

        found = own.select("doc", "vector").mapInArrow(run, "head bigint, doc bigint, score double")
        result = found if result is None else result.unionByName(found)
    top = ranked(result, k, F.desc("score"), F.col("doc"), by="head")
    asked = queries.join(same, "vector").select("qid", "head")
    return asked.join(top, "head").join(own.select("doc", "chunk_id"), "doc").select("qid", "chunk_id", "score", "rank")


class Nearest:
    """The k best rows of each query by cosine, rounded to six digits, ties to the lower number.

    Products of single precision only pass over what is below a query's k-th score by more
    than their error; what they leave is scored again in double precision."""

    QUERIES, FIRST, MOST, HELD = 512, 1024, 8192, 65536

    def __init__(self, queries, k: int) -> None:
        import numpy as np

        self.np, self.k = np, k
        self.q = self.unit(queries)
        self.q32 = self.q.astype(np.float32)
        self.margin = 2e-6 + 3e-7 * self.q.shape[1]
        blocks = range(0, len(self.q), self.QUERIES)
        self.best = {s: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for s in blocks}
        self.least = np.full(len(self.q), -np.inf)
        self.held: list = []

    def unit(self, v):
        v = v.astype(self.np.float64)
        return v / self.np.maximum(self.np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def add(self, docs, vectors) -> None:
        self.held.append((docs, self.unit(vectors)))
        if sum(len(d) for d, _ in self.held) >= self.HELD:
            self.flush()

    def flush(self) -> None:
        np, k = self.np, self.k
        if not self.held:
            return
        docs, v = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        v32 = v.astype(np.float32)
        for start in self.best:
            q, q32, least = self.q[start : start + self.QUERIES], self.q32[start : start + self.QUERIES], self.least[start : start + self.QUERIES]
            at, step = 0, self.FIRST
            while at < len(docs):
                s = q32 @ v32[at : at + step].T
                floor = least - self.margin
                if s.shape[1] >= k and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k] - self.margin)
                i, j = np.divmod(np.flatnonzero(s >= floor[:, None].astype(np.float32)), s.shape[1])
                exact = np.empty(len(i))
                for n in range(0, len(i), 65536):
                    part = slice(n, n + 65536)
                    exact[part] = np.einsum("ij,ij->i", q[i[part]], v[at + j[part]])
                qi, di, si = (np.concatenate(x) for x in zip(self.best[start], (i, docs[at + j], np.round(exact, 6))))
                order = np.lexsort((di, -si, qi))
                qi, di, si = qi[order], di[order], si[order]
                first = np.searchsorted(qi, np.arange(len(q)))
                place = np.arange(len(qi)) - first[qi]
                least[qi[place == k - 1]] = si[place == k - 1]
                kept = place < k
                self.best[start] = (qi[kept], di[kept], si[kept])
                at, step = at + step, min(2 * step, self.MOST) if at else step

    def found(self):
        np = self.np
        self.flush()
        parts = [(start + qi, di, si) for start, (qi, di, si) in self.best.items()]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def vector_search(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k distinct contents nearest to each query; three times as many are looked at, as
    copies are collapsed."""
    near = vector_topk(vectors, queries, 3 * k).withColumnRenamed("rank", "pos")
    once = chunks.select("chunk_id", "content_hash", "citation").dropDuplicates(["chunk_id"])
    return dedup(near.join(once, "chunk_id"), k).withColumnRenamed("pos", "rank")


def fuse(legs: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(qid, chunk_id, score, ranks): reciprocal rank fusion of legs (qid, chunk_id, rank)."""
    parts = [df.select("qid", "chunk_id", F.lit(name).alias("leg"), "rank", F.lit(float(w)).alias("weight")) for name, (df, w) in legs.items()]
    return fused(reduce(DataFrame.unionByName, parts))


def fused(rows: DataFrame, *more: str) -> DataFrame:
    """Fusion of rows (qid, chunk_id, leg, rank, weight), with what else they say of a chunk."""
    return rows.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("leg", "rank")))).alias("ranks"), *[F.first(c).alias(c) for c in more]
    )


def intent(question: Column) -> Column:
    a, d = question.rlike(ATTRIBUTION), question.rlike(DOCUMENTARY)
    return F.when(d & ~a, "documentary").when(a, "attribution").otherwise("general")


def prior(intent_: Column, source_type: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for i, weights in PRIORS.items():
        for kind, w in weights.items():
            out = out.when((intent_ == i) & (source_type == kind), w)
    return out.otherwise(OTHER_PRIOR)


def own_terms() -> Column:
    """Terms of a chunk (text, citation) that a question's terms may meet."""
    return S.query_terms(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("citation", F.lit(""))))


def coverage(terms: Column, own: Column) -> Column:
    """Share of a question's terms among a chunk's."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(own, terms)) / F.size(terms)).otherwise(0.0)


def rerank(rows: DataFrame) -> DataFrame:
    """Rows (q, text, citation, source_type, score) with fusion_score, rerank_intent,
    source_prior, term_coverage, and score = fusion * prior + a share of coverage."""
    asked = rows.withColumn("rerank_intent", intent(F.col("q"))).withColumn("source_prior", prior(F.col("rerank_intent"), F.col("source_type")))
    return weighed(asked.withColumn("_coverage", coverage(S.query_terms(F.col("q")), own_terms())))


def weighed(rows: DataFrame) -> DataFrame:
    """What rerank returns, of rows with source_prior and _coverage."""
    return (
        rows.withColumn("fusion_score", F.col("score"))
        .withColumn("score", F.col("fusion_score") * F.col("source_prior") + F.col("_coverage") * COVERAGE_WEIGHT)
        .withColumn("term_coverage", F.round("_coverage", 4))
        .drop("_coverage")
    )


def dedup(rows: DataFrame, k: int | None, pos: str = "pos") -> DataFrame:
    """The first k distinct contents of each question, or all, with the citations of later
    copies; no window is over all rows of a question but the one that takes the first k."""
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("chunk_id"))
    w = Window.partitionBy("qid", "_key").orderBy(pos)
    copies = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).withColumn("duplicates", F.collect_list(F.when(F.col("_n") > 1, F.col("citation"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = copies.where("_n = 1").drop("_key", "_n")
    return first if k is None else ranked(first, k, F.col(pos)).withColumn(pos, F.col("rank")).drop("rank")


def diversify(rows: DataFrame, k: int, per_file: int = PER_FILE, pos: str = "pos") -> DataFrame:
    """k rows of each question, at most per_file of one source unless too few are left."""
    source = F.coalesce(F.when(F.col("source_file") != "", F.col("source_file")), F.col("chunk_id"), F.lit(""))
    w = Window.partitionBy("qid", "_source").orderBy(pos)
    capped = rows.withColumn("_source", source).withColumn("_over", F.row_number().over(w) > per_file)
    return ranked(capped, k, F.col("_over"), F.col(pos)).drop("_source", "_over").withColumn(pos, F.col("rank")).drop("rank")


def budget(rows: DataFrame, limit: int, size: str, pos: str = "pos", by: str = "qid") -> DataFrame:
    """The longest prefix of each question within a size; its first row always stays."""
    w = Window.partitionBy(by).orderBy(pos)
    run = rows.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(w) == 1)
    return run.where(F.col("_first") | (F.col("_sum") <= limit)).drop("_sum", "_first")
