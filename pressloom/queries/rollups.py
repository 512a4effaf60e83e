"""Reports, the query log, conversations, evaluation, ingestion state and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.operators import extraction as X
from pressloom.operators import manifest as T
from pressloom.operators import reports as L
from pressloom.queries.retrieval import _hybrid, found, questions
from pressloom.sources.tables import table
from pressloom.streaming import quotas as Q


def corpus_facets(spark, d) -> DataFrame:
    return L.facets(table(spark, d, "chunks", "source_type", "publication", "language"))


def corpus_coverage(spark, d) -> DataFrame:
    return L.coverage(table(spark, d, "chunks", "date", "press_meet_id"))


def _log(spark, d) -> DataFrame:
    """Events as a query log: the value stands for latency, purchases for refusals."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("user"), F.col("value").alias("latency_s"), (F.col("event_id") % 3).alias("uncited"), (F.col("event_id") % 2).alias("invalid"), (F.col("event_type") == "purchase").alias("refused"),
        (F.col("event_type") == "view").alias("grounded"), F.col("event_type").alias("question"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("answer"),
    )


def querylog_stats(spark, d) -> DataFrame:
    return L.log_stats(_log(spark, d))


def querylog_users(spark, d) -> DataFrame:
    return L.log_by_user(_log(spark, d))


def session_summary(spark, d) -> DataFrame:
    return L.sessions(L.sessionize(_log(spark, d), 86_400)).select("user", "session_id", "title", "turns", "last_question", "preview", "uncited_sentences", "stripped_citations", "refusals")


def session_search(spark, d) -> DataFrame:
    return L.search_sessions(L.sessionize(_log(spark, d), 86_400), "purchase").select("user", "session_id", "turns", "refusals")


def _scores(spark, d) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "meets", "kind", "lang").withColumnRenamed("item_id", "qid")
    return L.score_retrieval(items, found(spark, d, questions(spark, d))).join(items.select("qid", "kind", "lang"), "qid")


def eval_scores(spark, d) -> DataFrame:
    return _scores(spark, d).select("qid", "meet_rank", F.round("reciprocal_rank", 4).alias("reciprocal_rank"), F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))


def eval_aggregate(spark, d) -> DataFrame:
    return L.aggregate_scores(_scores(spark, d))


def eval_by_neighbours(spark, d) -> DataFrame:
    """Scores of a plain ranking, latest chunks of the items' languages first."""
    items = table(spark, d, "eval_items", "item_id", "meets", "lang").withColumnRenamed("item_id", "qid")
    c = table(spark, d, "chunks", "chunk_id", "language", "date", "press_meet_id").dropDuplicates(["chunk_id"])
    from pressloom.operators.ranking import ranked

    top = ranked(c.where("date is not null"), 8, F.desc("date"), F.col("chunk_id"), by="language")
    hits = items.select("qid", F.col("lang").alias("language")).join(top, "language").select("qid", "rank", "press_meet_id")
    s = L.score_retrieval(items, hits)
    return s.select("qid", "meet_rank", F.round("reciprocal_rank", 4).alias("reciprocal_rank"), F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))


def manifest_current(spark, d) -> DataFrame:
    return T.current(table(spark, d, "manifest", "path", "sha1", "size", "stages", "updated")).select("path", "sha1", "size", F.size("stages").alias("n_stages"))


def stage_summary(spark, d) -> DataFrame:
    return T.summary(table(spark, d, "manifest", "path", "sha1", "stages", "updated"))


def stage_pending(spark, d) -> DataFrame:
    files = table(spark, d, "extracted_docs", "source_file", "file_hash").where("file_hash <> ''").distinct().select(F.col("source_file").alias("path"), F.col("file_hash").alias("sha1"))
    return T.pending(files, table(spark, d, "manifest", "path", "sha1", "stages", "updated"), "chunk")


def docs_upsert(spark, d) -> DataFrame:
    """Files with an error are delivered anew without it."""
    x = table(spark, d, "extracted_docs", "source_file", "source_type", "error").distinct()
    fixed = x.where("error is not null").withColumn("error", F.lit(None).cast("string")).distinct()
    return T.upsert(x, fixed, "source_file").groupBy("source_type").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def cache_latest(spark, d) -> DataFrame:
    c = table(spark, d, "chunks", "content_hash", "source_file", "chunk_id").where("content_hash <> ''").distinct()
    return T.latest(c, "content_hash", "chunk_id").select("content_hash", "chunk_id", "source_file")


def cache_reusable(spark, d) -> DataFrame:
    x = table(spark, d, "extracted_docs", "extractor").select(F.concat_ws("/", F.coalesce("extractor", F.lit("fixture")), F.lit("m1"), F.lit("p2")).alias("fp"))
    return x.groupBy(T.reusable(F.col("fp"), F.lit("local/m2/p2")).alias("reusable")).agg(F.count("*").alias("n"))


def billed_calls(spark, d) -> DataFrame:
    return L.calls(table(spark, d, "extracted_docs", "source_file", "sarvam_calls"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events", "event_id", "user_id", "ts").withColumnRenamed("user_id", "user")


def sliding_quota_count(spark, d) -> DataFrame:
    return Q.trailing_count(_events(spark, d)).select("event_id", "in_window")


def quota_accept(spark, d) -> DataFrame:
    return Q.accepted(_events(spark, d), limit=2, seconds=86_400)


def tumbling_events(spark, d) -> DataFrame:
    return Q.tumbling(_events(spark, d), 3600)


def login_throttle(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").select("event_id", F.col("user_id").alias("user"), (F.col("user_id") % 10).alias("ip"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    return Q.failures(e, limit=3, seconds=86_400).groupBy("by").agg(F.count_if("blocked").alias("blocked"))


def export_inventory(spark, d) -> DataFrame:
    f = spark.read.format("binaryFile").load(f"{d}/press_meets.parquet")
    return T.inventory(f).select(F.element_at(F.split("path", "/"), -1).alias("file"), S.human_bytes(F.col("length")).alias("size"), "sha256")


def unknown_meets(spark, d) -> DataFrame:
    return L.unknown_meets(table(spark, d, "eval_items", "item_id", "meets").withColumnRenamed("item_id", "qid"), table(spark, d, "press_meets", "press_meet_id"))


def manifest_rebuilt(spark, d) -> DataFrame:
    m = T.rebuilt(table(spark, d, "extracted_docs", "source_file", "file_hash", "error"))
    return m.select("path", "sha1", F.element_at("stages", "extract").alias("extract"), F.size("stages").alias("n_stages"))


def type_counts(spark, d) -> DataFrame:
    return L.type_counts(table(spark, d, "segments", "segment_id", "source_type", "text_original"), table(spark, d, "chunks", "chunk_id", "source_type", "text"))


def extraction_plan(spark, d) -> DataFrame:
    """Chunks that earlier files share are taken for cached."""
    c = table(spark, d, "chunks", "chunk_id", "text", "content_hash", "source_file", "source_type").distinct()
    chosen = c.withColumn("skip", F.when(F.length("text") < 150, "short"))
    return X.plan_report(chosen, c.where("source_type = 'table'").select("content_hash"))


QUERIES = {
    "unknown_meets": unknown_meets, "manifest_rebuilt": manifest_rebuilt, "type_counts": type_counts, "extraction_plan": extraction_plan,
    "corpus_meta": corpus_facets, "corpus_coverage": corpus_coverage, "querylog_stats": querylog_stats, "querylog_users": querylog_users, "session_summary": session_summary, "session_search": session_search, "eval_scores": eval_scores,
    "eval_aggregate": eval_aggregate, "eval_plain_ranking": eval_by_neighbours, "manifest_current": manifest_current, "stage_summary": stage_summary, "stage_pending": stage_pending, "docs_upsert": docs_upsert, "cache_latest": cache_latest, "cache_reusable": cache_reusable,
    "billed_calls": billed_calls, "sliding_quota_count": sliding_quota_count, "quota_accept": quota_accept, "tumbling_events": tumbling_events, "login_throttle": login_throttle, "export_inventory": export_inventory,
}

_LOG = "l AS (SELECT event_id, ts, user_id AS \"user\", value AS latency_s, event_id % 3 AS uncited, event_id % 2 AS invalid, event_type = 'purchase' AS refused, event_type = 'view' AS grounded, event_type AS question, event_type || ' ' || event_id AS answer FROM events)"
_SES = f"{_LOG}, f AS (SELECT *, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY \"user\" ORDER BY ts, event_id) > 86400 OR lag(ts) OVER (PARTITION BY \"user\" ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM l), g AS (SELECT *, sum(fresh) OVER (PARTITION BY \"user\" ORDER BY ts, event_id)::BIGINT AS session_id FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY \"user\", session_id ORDER BY ts, event_id) AS turn FROM g)"
_CUR = "cur AS (SELECT path, arg_max(sha1, (updated, sha1)) AS sha1, arg_max(size, (updated, sha1)) AS size, arg_max(stages, (updated, sha1)) AS stages FROM manifest GROUP BY 1)"
_ST = "st AS (SELECT path, sha1, e.key AS stage, e.value AS state FROM (SELECT path, sha1, unnest(map_entries(stages)) AS e FROM cur))"

_EVAL = f"{_hybrid()}, j AS (SELECT item_id AS qid, kind, lang, list_distinct(meets) AS meets, rank, press_meet_id FROM eval_items LEFT JOIN hits ON hits.qid = item_id), h AS (SELECT *, coalesce(list_contains(meets, press_meet_id), false) AS hit FROM j), e AS (SELECT qid, any_value(kind) AS kind, any_value(lang) AS lang, min(rank) FILTER (hit) AS meet_rank, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0.0) AS reciprocal_rank, coalesce(count(DISTINCT press_meet_id) FILTER (hit) / nullif(len(any_value(meets)), 0), 0.0) AS recall, coalesce(count(*) FILTER (hit) / nullif(count(rank), 0), 0.0) AS precision FROM h GROUP BY 1)"
_MEANS = "count(*) AS n, round(avg((meet_rank IS NOT NULL)::INT::DOUBLE), 3) AS meet_hit_rate, round(avg(reciprocal_rank), 3) AS mrr, round(avg(recall), 3) AS recall, round(avg(precision), 3) AS precision FROM e"
_BLOCK = lambda by: f"SELECT '{by}' AS \"by\", count(*) FILTER (blocked) AS blocked FROM (SELECT count(*) FILTER (NOT ok) OVER (PARTITION BY k, since ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) >= 3 AS blocked FROM (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM (SELECT event_id, ts, event_type = 'purchase' AS ok, user_id{' % 10' if by == 'ip' else ''} AS k FROM events)))"

SQL = {
    "unknown_meets": "SELECT DISTINCT item_id AS qid, meet FROM (SELECT item_id, unnest(meets) AS meet FROM eval_items) WHERE meet NOT IN (SELECT press_meet_id FROM press_meets)",
    "manifest_rebuilt": "SELECT source_file AS path, max(nullif(file_hash, '')) AS sha1, CASE WHEN bool_or(error IS NOT NULL) THEN 'error' ELSE 'done' END AS extract, CASE WHEN bool_or(error IS NOT NULL) THEN 1 ELSE 2 END::INT AS n_stages FROM extracted_docs GROUP BY 1",
    "type_counts": "SELECT 'extract' AS stage, source_type, count(DISTINCT segment_id) AS n, max(length(text_original))::INT AS longest FROM segments GROUP BY 2 UNION ALL SELECT 'chunk', source_type, count(DISTINCT chunk_id), max(length(text))::INT FROM chunks GROUP BY 2",
    "extraction_plan": "WITH c AS (SELECT DISTINCT chunk_id, text, content_hash, source_file, source_type FROM chunks), k AS (SELECT DISTINCT content_hash AS k FROM c WHERE source_type = 'table'), r AS (SELECT length(text) AS n, length(text) >= 150 OR text IS NULL AS picked, k.k IS NOT NULL AS cached FROM c LEFT JOIN k ON coalesce(nullif(content_hash, ''), chunk_id) = k.k) SELECT count(*) AS chunks, count(*) FILTER (picked) AS selected, count(*) FILTER (picked AND cached) AS cached, count(*) FILTER (picked AND NOT cached) AS calls, coalesce(sum(n) FILTER (picked AND NOT cached), 0)::BIGINT AS chars, (coalesce(sum(n) FILTER (picked AND NOT cached), 0) // 3 + count(*) FILTER (picked AND NOT cached) * 700)::BIGINT AS input_tokens, count(*) FILTER (picked AND NOT cached) * 400 AS output_tokens FROM r",
    "eval_scores": f"WITH {_EVAL} SELECT qid, meet_rank, round(reciprocal_rank, 4) AS reciprocal_rank, round(recall, 4) AS recall, round(precision, 4) AS precision FROM e",
    "eval_aggregate": f"WITH {_EVAL} SELECT 'all' AS kind, 'all' AS lang, {_MEANS} UNION ALL SELECT kind, 'all', {_MEANS} GROUP BY kind UNION ALL SELECT 'all', lang, {_MEANS} GROUP BY lang",
    "login_throttle": f"{_BLOCK('user')} UNION ALL {_BLOCK('ip')}",
    "quota_accept": "WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r(event_id, user_id, rn, ok, held) AS (SELECT event_id, user_id, rn, true, [t] FROM o WHERE rn = 1 UNION ALL SELECT event_id, user_id, rn, len(h) < 2, CASE WHEN len(h) < 2 THEN list_append(h, t) ELSE h END FROM (SELECT o.event_id, o.user_id, o.rn, o.t, list_filter(r.held, lambda x: o.t - x <= 86400000000) AS h FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)) SELECT event_id, user_id AS \"user\", ok AS accepted FROM r",
    "corpus_meta": "SELECT facet, value, count(*) AS n FROM (SELECT 'source_type' AS facet, source_type AS value FROM chunks UNION ALL SELECT 'publication', publication FROM chunks UNION ALL SELECT 'language', language FROM chunks) WHERE value <> '' GROUP BY 1, 2",
    "corpus_coverage": "SELECT count(*) AS chunks, count(nullif(date, '')) AS dated_chunks, min(nullif(date, '')) AS start, max(nullif(date, '')) AS \"end\", count(DISTINCT press_meet_id) AS press_meets FROM chunks",
    "querylog_stats": f"WITH {_LOG} SELECT count(*) AS queries, round(avg(latency_s), 2) AS mean_latency_s, round(avg(uncited), 2) AS mean_uncited_sentences, count(*) FILTER (invalid > 0) AS answers_with_stripped_citations, round(count(*) FILTER (grounded) / count(*), 4) AS grounding_pass_rate, round(count(*) FILTER (refused) / count(*), 4) AS refusal_rate FROM l",
    "querylog_users": "SELECT user_id AS \"user\", count(*) AS queries FROM events GROUP BY 1",
    "session_summary": f"WITH {_SES} SELECT \"user\", session_id, substr(arg_min(question, turn), 1, 70) AS title, count(*) AS turns, arg_max(question, turn) AS last_question, substr(arg_max(answer, turn), 1, 180) AS preview, sum(uncited)::BIGINT AS uncited_sentences, sum(invalid)::BIGINT AS stripped_citations, count(*) FILTER (refused) AS refusals FROM s GROUP BY 1, 2",
    "session_search": f"WITH {_SES} SELECT \"user\", session_id, count(*) AS turns, count(*) FILTER (refused) AS refusals FROM s GROUP BY 1, 2 HAVING bool_or(contains(lower(question), 'purchase') OR contains(lower(answer), 'purchase'))",
    "eval_plain_ranking": "WITH c AS (SELECT DISTINCT chunk_id, language, date, press_meet_id FROM chunks WHERE date IS NOT NULL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY date DESC, chunk_id)::INT AS rank FROM c) WHERE rank <= 8), j AS (SELECT item_id AS qid, list_distinct(meets) AS meets, rank, press_meet_id FROM eval_items LEFT JOIN t ON lang = language), h AS (SELECT *, coalesce(list_contains(meets, press_meet_id), false) AS hit FROM j) SELECT qid, min(rank) FILTER (hit) AS meet_rank, round(coalesce(1.0 / min(rank) FILTER (hit), 0.0), 4) AS reciprocal_rank, round(coalesce(count(DISTINCT press_meet_id) FILTER (hit) / nullif(len(any_value(meets)), 0), 0.0), 4) AS recall, round(coalesce(count(*) FILTER (hit) / nullif(count(rank), 0), 0.0), 4) AS precision FROM h GROUP BY 1",
    "manifest_current": f"WITH {_CUR} SELECT path, sha1, size, cardinality(stages)::INT AS n_stages FROM cur",
    "stage_summary": f"WITH {_CUR}, {_ST} SELECT stage, state, count(*) AS n FROM st GROUP BY 1, 2",
    "stage_pending": f"WITH {_CUR}, {_ST} SELECT DISTINCT source_file AS path, file_hash AS sha1 FROM extracted_docs WHERE file_hash <> '' AND (source_file, file_hash) NOT IN (SELECT path, sha1 FROM st WHERE stage = 'chunk' AND state = 'done' AND sha1 IS NOT NULL)",
    "docs_upsert": "WITH x AS (SELECT DISTINCT source_file, source_type, error FROM extracted_docs), r AS (SELECT DISTINCT source_file, source_type, NULL::VARCHAR AS error FROM x WHERE error IS NOT NULL) SELECT source_type, count(*) AS n, count(error) AS errors FROM (SELECT * FROM x WHERE source_file NOT IN (SELECT source_file FROM r) UNION ALL SELECT * FROM r) GROUP BY 1",
    "cache_latest": "SELECT content_hash, max(chunk_id) AS chunk_id, arg_max(source_file, chunk_id) AS source_file FROM chunks WHERE content_hash <> '' GROUP BY 1",
    "cache_reusable": "SELECT a[1] = 'local' OR (lower(a[1]) IN ('fixture', 'fake')) = false AS reusable, count(*) AS n FROM (SELECT string_split(coalesce(extractor, 'fixture') || '/m1/p2', '/') AS a FROM extracted_docs) GROUP BY 1",
    "billed_calls": "SELECT kind, sum(n)::BIGINT AS n FROM (SELECT e.key AS kind, e.value AS n FROM (SELECT unnest(map_entries(any_value(sarvam_calls))) AS e FROM extracted_docs GROUP BY source_file)) GROUP BY 1",
    "sliding_quota_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "tumbling_events": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
}
