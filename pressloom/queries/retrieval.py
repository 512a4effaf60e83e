"""Ranking: lexical and vector legs, fusion, re-ranking, duplicates, diversity, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.operators import extraction as X
from pressloom.operators import ranking as R
from pressloom.operators.filters import Filters
from pressloom.plans.retrieve import passages
from pressloom.queries.documents import _terms
from pressloom.session import kept
from pressloom.sources.tables import table


def questions(spark, d) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "q").select(F.col("item_id").alias("qid"), "q")


def chunks(spark, d) -> DataFrame:
    return table(spark, d, "chunks", "chunk_id", "text", "citation", "source_type", "source_file", "content_hash", "press_meet_id", "date", "language", "publication")


def index(spark, d) -> DataFrame:
    """The postings of all chunks, written once and read from then on, sorted by term."""
    return kept(spark, "postings", [f"{d}/chunks.parquet"], lambda: R.with_frequencies(R.postings(table(spark, d, "chunks", "chunk_id", "text"))).sortWithinPartitions("term"))


def index_stats(spark, d) -> DataFrame:
    return kept(spark, "stats", [f"{d}/chunks.parquet"], lambda: R.index_stats(index(spark, d)))


def chunk_vectors(spark, d) -> DataFrame:
    """Numbered vectors of all chunks by the offline embedder, written once."""
    once = lambda: table(spark, d, "chunks", "chunk_id", "text").groupBy("chunk_id").agg(F.min("text").alias("text"))
    made = lambda: kept(spark, "vectors", [f"{d}/chunks.parquet"], lambda: X.embed(once(), "chunk_id", "text"))
    return kept(spark, "numbered", [f"{d}/chunks.parquet"], lambda: R.numbered(made()))


def question_vectors(q: DataFrame) -> DataFrame:
    return X.embed(q, "qid", "q")


def bm25_topk(spark, d) -> DataFrame:
    return R.bm25(index(spark, d), questions(spark, d), 10, index_stats(spark, d)).select("qid", "chunk_id", F.round("score", 4).alias("score"), "rank")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))


def vector_topk(spark, d) -> DataFrame:
    """Every twentieth vector against all of them."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return R.vector_topk(_vectors(spark, d), asked, 10).select("qid", "chunk_id", F.round("score", 4).alias("score"))


def fused(spark, d) -> DataFrame:
    """Fusion of the lexical leg with one ordered by date."""
    c = chunks(spark, d)
    key = R.bm25(index(spark, d), questions(spark, d), 20, index_stats(spark, d))
    recent = R.ranked(key.select("qid", "chunk_id").join(c.groupBy("chunk_id").agg(F.max("date").alias("date")), "chunk_id"), 20, F.desc_nulls_last("date"), F.col("chunk_id"))
    return R.fuse({"keyword": (key, 1.0), "recent": (recent, 0.5)}).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def intents(spark, d) -> DataFrame:
    q = questions(spark, d).select("qid", R.intent(F.col("q")).alias("intent"))
    return q.groupBy("intent").agg(F.count("*").alias("n"))


def reranked(spark, d) -> DataFrame:
    c = chunks(spark, d).dropDuplicates(["chunk_id"])
    hits = R.fuse({"keyword": (R.bm25(index(spark, d), questions(spark, d), 20, index_stats(spark, d)), 1.0)})
    rows = R.rerank(hits.join(c, "chunk_id").join(questions(spark, d), "qid"))
    return rows.select("qid", "chunk_id", F.round("score", 6).alias("score"), "source_prior", "term_coverage")


def best_copies(spark, d) -> DataFrame:
    c = chunks(spark, d).dropDuplicates(["chunk_id"]).withColumn("qid", F.col("press_meet_id"))
    rows = R.dedup(c, None, "chunk_id")
    return rows.select("chunk_id", F.size("duplicates").alias("n_copies"))


def diverse(spark, d) -> DataFrame:
    c = chunks(spark, d).dropDuplicates(["chunk_id"]).withColumn("qid", F.col("press_meet_id"))
    rows = c.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("date"), "chunk_id")))
    return R.diversify(rows, 12).select(F.col("qid").alias("press_meet_id"), "chunk_id", "pos")


def budgets(spark, d) -> DataFrame:
    c = chunks(spark, d).dropDuplicates(["chunk_id"]).withColumn("qid", F.col("source_file")).withColumn("size", F.length("text"))
    rows = c.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")))
    return R.budget(rows, 2500, "size").select("chunk_id", "pos", "size")


def found(spark, d, q: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Passages by the lexical and the vector leg."""
    return passages(chunks(spark, d), q, vectors=chunk_vectors(spark, d), question_vectors=question_vectors(q), filters=filters, index=index(spark, d), stats=index_stats(spark, d))


def hybrid(spark, d) -> DataFrame:
    return found(spark, d, questions(spark, d)).select("qid", "rank", "chunk_id", F.round("score", 5).alias("score"))


def hybrid_filtered(spark, d) -> DataFrame:
    return found(spark, d, questions(spark, d), Filters(source_type="press_release", since="2025-01-01")).select("qid", "rank", "chunk_id")


def one_question(spark, d) -> DataFrame:
    """The first question alone: what one user waits for."""
    return found(spark, d, questions(spark, d).where("qid = 1")).select("qid", "rank", "chunk_id")


def embedded(spark, d) -> DataFrame:
    """The vector leg over the chunks themselves."""
    return R.vector_topk(chunk_vectors(spark, d), question_vectors(questions(spark, d)), 10).select("qid", "chunk_id", "rank")


QUERIES = {
    "bm25_topk": bm25_topk, "vector_topk": vector_topk, "rrf_fusion": fused, "question_intents": intents, "rerank_source_prior": reranked, "dedup_best_copy": best_copies, "diversify_per_source": diverse, "prompt_budget": budgets, "hybrid_retrieve": hybrid, "hybrid_one_question": one_question, "vector_leg": embedded, "hybrid_retrieve_filtered": hybrid_filtered,
}

_ONCE = "SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1"
_BM25 = f"""p AS (SELECT chunk_id, regexp_extract_all(lower(text), '{S.WORD_RE2}') AS ws FROM ({_ONCE}) WHERE text IS NOT NULL), t AS (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM p WHERE len(ws) > 0),
    i AS (SELECT term, chunk_id, dl, count(*) AS tf FROM t GROUP BY 1, 2, 3), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM p WHERE len(ws) > 0), dfs AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
    a AS (SELECT item_id AS qid, unnest({_terms('q')}) AS term FROM eval_items), sc AS (SELECT qid, i.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM a JOIN i USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM sc)"""
_A = "'(?i)\\b(?:said|say|statement|statements|allege|alleged|allegations|criticise|criticized|response|respond)\\b|అన్నారు|చెప్పారు|ఆరోపణ|విమర్శ'"
_D = "'(?i)\\b(?:court|supreme court|sit|cag|report|order|verdict|conclude|concluded|document|tariff filing)\\b|కోర్టు|నివేదిక|తీర్పు'"
_INTENT = f"CASE WHEN regexp_matches(q, {_D}) AND NOT regexp_matches(q, {_A}) THEN 'documentary' WHEN regexp_matches(q, {_A}) THEN 'attribution' ELSE 'general' END"
_PRIOR = "CASE " + " ".join(f"WHEN intent = '{i}' AND source_type = '{k}' THEN {w}" for i, ws in R.PRIORS.items() for k, w in ws.items()) + " ELSE 0.9 END"
_COVER = f"coalesce(len(list_intersect({_terms('q')}, {_terms("concat_ws(' ', coalesce(text, ''), coalesce(citation, ''))")})) / nullif(len({_terms('q')}), 0), 0.0)"
_C = "c AS (SELECT DISTINCT chunk_id, text, citation, source_type, source_file, content_hash, press_meet_id, date FROM chunks)"

#: Signed counts of the words of a text in 64 buckets, by md5.
def _vec(k: str, t: str, x: str) -> str:
    counted = f"SELECT {k}, ('0x' || substr(md5(w), 1, 2))::INT % 64 AS b, sum(CASE WHEN substr(md5(w), 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM (SELECT {k}, unnest(regexp_extract_all(lower({x}), '{S.WORD_RE2}')) AS w FROM {t}) GROUP BY 1, 2"
    return f"(SELECT {k}, list(coalesce(s, 0) ORDER BY b) AS v FROM (SELECT i.{k}, g.b, n.s FROM (SELECT DISTINCT {k} FROM {t}) i CROSS JOIN (SELECT unnest(range(64)) AS b) g LEFT JOIN ({counted}) n ON n.{k} = i.{k} AND n.b = g.b) GROUP BY 1 HAVING count(*) FILTER (s <> 0) > 0)"


ITEMS = "(SELECT item_id AS qid, q FROM eval_items)"


def _near(where: str = "", asked: str = ITEMS) -> str:
    """Common tables up to nv: the vector leg over chunks that pass."""
    return f"""cv AS {_vec('chunk_id', f'(SELECT chunk_id, min(text) AS text FROM chunks {where} GROUP BY 1 HAVING min(text) IS NOT NULL)', 'text')}, qv AS {_vec('qid', asked, 'q')},
    nv AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT qid, chunk_id, round(list_cosine_similarity(cv.v, qv.v), 6) AS score FROM cv, qv))"""


def _hybrid(where: str = "", k: int = 8, asked: str = ITEMS) -> str:
    """Common tables up to ``hits``: (qid, rank, chunk_id, score, press_meet_id)."""
    reach = 4 * k
    once = _BM25.replace("SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1", f"SELECT chunk_id, min(text) AS text FROM chunks {where} GROUP BY 1").replace(f"SELECT item_id AS qid, unnest({_terms('q')}) AS term FROM eval_items", f"SELECT qid, unnest({_terms('q')}) AS term FROM {asked}")
    return f"""{once}, {_near(where, asked)}, {_C}, fu AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS f, count(*) AS legs FROM (SELECT qid, chunk_id, rank FROM top WHERE rank <= {reach} UNION ALL SELECT qid, chunk_id, rank FROM nv WHERE rank <= {reach}) GROUP BY 1, 2),
    x AS (SELECT *, {_INTENT} AS intent FROM fu JOIN c USING (chunk_id) JOIN {asked} USING (qid)), y AS (SELECT *, f * ({_PRIOR})::DOUBLE + {_COVER} * 0.0015::DOUBLE AS score, coalesce(nullif(content_hash, ''), chunk_id) AS key FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS pos FROM y), u AS (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(nullif(source_file, ''), chunk_id) ORDER BY pos) > 2 AS over FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos) AS copy FROM z) WHERE copy = 1),
    hits AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY over, pos)::INT AS rank, chunk_id, score, press_meet_id, legs, text, citation, date FROM u) WHERE rank <= {k})"""


SQL = {
    "vector_leg": f"WITH {_near()} SELECT qid, chunk_id, rank FROM nv WHERE rank <= 10",
    "hybrid_retrieve": f"WITH {_hybrid()} SELECT qid, rank, chunk_id, round(score, 5) AS score FROM hits",
    "hybrid_one_question": f"WITH {_hybrid()} SELECT qid, rank, chunk_id FROM hits WHERE qid = 1",
    "hybrid_retrieve_filtered": f"""WITH {_hybrid("WHERE source_type = 'press_release' AND date >= '2025-01-01'")} SELECT qid, rank, chunk_id FROM hits""",
    "bm25_topk": f"WITH {_BM25} SELECT qid, chunk_id, round(score, 4) AS score, rank FROM top WHERE rank <= 10",
    "vector_topk": "SELECT qid, chunk_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM (SELECT a.vec_id AS qid, b.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE r <= 10",
    "rrf_fusion": f"WITH {_BM25}, k AS (SELECT qid, chunk_id, rank FROM top WHERE rank <= 20), r AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY date DESC NULLS LAST, chunk_id) AS rank FROM k JOIN (SELECT chunk_id, max(date) AS date FROM chunks GROUP BY 1) USING (chunk_id)) SELECT qid, chunk_id, round(round(sum(w / (60 + rank)), 9), 6) AS score FROM (SELECT qid, chunk_id, rank, 1.0 AS w FROM k UNION ALL SELECT qid, chunk_id, rank, 0.5 FROM r WHERE rank <= 20) GROUP BY 1, 2",
    "question_intents": f"SELECT {_INTENT} AS intent, count(*) AS n FROM eval_items GROUP BY 1",
    "rerank_source_prior": f"WITH {_BM25}, {_C}, x AS (SELECT *, {_INTENT} AS intent FROM (SELECT qid, chunk_id, round(1.0 / (60 + rank), 9) AS f FROM top WHERE rank <= 20) JOIN c USING (chunk_id) JOIN (SELECT item_id AS qid, q FROM eval_items) USING (qid)) SELECT qid, chunk_id, round(f * ({_PRIOR})::DOUBLE + {_COVER} * 0.0015, 6) AS score, ({_PRIOR})::DOUBLE AS source_prior, round({_COVER}, 4) AS term_coverage FROM x",
    "dedup_best_copy": f"WITH {_C} SELECT min(chunk_id) AS chunk_id, (count(*) - 1)::INT AS n_copies FROM (SELECT *, coalesce(nullif(content_hash, ''), chunk_id) AS key FROM c) GROUP BY press_meet_id, key",
    "diversify_per_source": f"WITH {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY press_meet_id ORDER BY date DESC NULLS LAST, chunk_id) AS pos FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY press_meet_id, source_file ORDER BY pos) > 2 AS over FROM p) SELECT press_meet_id, chunk_id, pos FROM (SELECT press_meet_id, chunk_id, row_number() OVER (PARTITION BY press_meet_id ORDER BY over, pos)::INT AS pos FROM o) WHERE pos <= 12",
    "prompt_budget": f"WITH {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_id)::INT AS pos FROM c) SELECT chunk_id, pos, size FROM (SELECT *, sum(size) OVER (PARTITION BY source_file ORDER BY pos) AS s FROM (SELECT *, length(text)::INT AS size FROM p)) WHERE pos = 1 OR s <= 2500",
}
