"""Roll-ups: corpus facets, query log, conversations, evaluation, stage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facets(chunks: DataFrame) -> DataFrame:
    """(facet, value, n): counts by kind, publication and language; a row stands for its three
    facets, which are counted before anything is shuffled."""
    keys = {"source_type": "source_type", "publication": "publication", "language": "language"}
    cols = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in keys]
    flat = chunks.select(F.posexplode(F.array(*cols)).alias("k", "value")).where("value is not null")
    facet = F.element_at(F.array(*map(F.lit, keys)), F.col("k") + 1)
    return flat.groupBy(facet.alias("facet"), "value").agg(F.count("*").alias("n"))


def coverage(chunks: DataFrame) -> DataFrame:
    """One row: chunks, dated chunks, first and last date, meets."""
    date = F.when(F.col("date") != "", F.col("date"))
    return chunks.agg(F.count("*").alias("chunks"), F.count(date).alias("dated_chunks"), F.min(date).alias("start"), F.max(date).alias("end"), F.countDistinct("press_meet_id").alias("press_meets"))


def log_stats(log: DataFrame, last: int | None = None) -> DataFrame:
    """One row over a query log (ts, user, latency_s, uncited, invalid, refused, grounded):
    volume, means, and rates over all rows; of the ``last`` rows where given."""
    rows = log.orderBy(F.desc("ts")).limit(last) if last else log
    n = F.count("*")
    return rows.agg(
        n.alias("queries"), F.round(F.avg("latency_s"), 2).alias("mean_latency_s"), F.round(F.avg("uncited"), 2).alias("mean_uncited_sentences"), F.count_if(F.col("invalid") > 0).alias("answers_with_stripped_citations"),
        F.round(F.count_if("grounded") / n, 4).alias("grounding_pass_rate"), F.round(F.count_if("refused") / n, 4).alias("refusal_rate"),
    )


def log_by_user(log: DataFrame) -> DataFrame:
    return log.groupBy("user").agg(F.count("*").alias("queries"))


def sessions(turns: DataFrame) -> DataFrame:
    """One card per (user, session): turns, first question as title, last question and preview,
    sums and means."""
    return turns.groupBy("user", "session_id").agg(
        F.substring(F.min_by("question", "turn"), 1, 70).alias("title"), F.count("*").alias("turns"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("question", "turn").alias("last_question"),
        F.substring(F.max_by("answer", "turn"), 1, 180).alias("preview"), F.sum("uncited").alias("uncited_sentences"), F.sum("invalid").alias("stripped_citations"), F.count_if("refused").alias("refusals"), F.round(F.avg("latency_s"), 2).alias("latency_s"),
    )


def search_sessions(turns: DataFrame, query: str) -> DataFrame:
    """Cards of sessions of which any title, question or answer contains the query."""
    q = query.lower()
    hit = turns.groupBy("user", "session_id").agg(F.bool_or(F.lower("question").contains(q) | F.lower("answer").contains(q)).alias("hit")).where("hit")
    return sessions(turns.join(hit, ["user", "session_id"], "left_semi"))


def sessionize(events: DataFrame, gap: int = 1800) -> DataFrame:
    """Events with the session and turn they belong to: a pause of over ``gap`` seconds begins
    a new session."""
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    fresh = F.coalesce(seconds - F.lag(seconds).over(w) > gap, F.lit(True)).cast("int")
    numbered = events.withColumn("_fresh", fresh).withColumn("session_id", F.sum("_fresh").over(w))
    return numbered.drop("_fresh").withColumn("turn", F.row_number().over(Window.partitionBy("user", "session_id").orderBy("ts", "event_id")))


def score_retrieval(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, meet_rank, reciprocal_rank, recall, precision) of retrieved (qid, rank,
    press_meet_id) against expected meets (qid, meets)."""
    want = questions.select("qid", F.array_distinct("meets").alias("meets"))
    joined = want.join(passages.select("qid", "rank", "press_meet_id"), "qid", "left").withColumn("hit", F.coalesce(F.array_contains("meets", F.col("press_meet_id")), F.lit(False)))
    per = joined.groupBy("qid").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("meet_rank"), F.countDistinct(F.when(F.col("hit"), F.col("press_meet_id"))).alias("covered"), F.count_if("hit").alias("hits"), F.count("rank").alias("n"), F.first(F.size("meets")).alias("expected")
    )
    return per.select(
        "qid", "meet_rank", F.when(F.col("meet_rank").isNull(), 0.0).otherwise(1.0 / F.col("meet_rank")).alias("reciprocal_rank"),
        F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(0.0).alias("recall"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("precision"),
    )


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """Means over all questions, by kind and by language, in one grouping-sets pass."""
    means = [F.round(F.avg(c), 3).alias(name) for c, name in ((F.col("meet_rank").isNotNull().cast("double"), "meet_hit_rate"), (F.col("reciprocal_rank"), "mrr"), (F.col("recall"), "recall"), (F.col("precision"), "precision"))]
    rows = scores.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("kind", "lang")})
    sets = rows.groupingSets([[], [F.col("kind")], [F.col("lang")]], F.col("kind"), F.col("lang")).agg(F.count("*").alias("n"), *means)
    return sets.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "meet_hit_rate", "mrr", "recall", "precision")


def calls(docs: DataFrame) -> DataFrame:
    """(kind, n): billed calls of all files by kind."""
    return docs.dropDuplicates(["source_file"]).select(F.explode("sarvam_calls").alias("kind", "n")).groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"))


def unknown_meets(questions: DataFrame, meets: DataFrame) -> DataFrame:
    """(qid, meet): expected meets of questions (qid, meets) that no row of meets is."""
    return questions.select("qid", F.explode("meets").alias("meet")).distinct().join(meets.select(F.col("press_meet_id").alias("meet")).distinct(), "meet", "left_anti").select("qid", "meet")


def entity_hits(questions: DataFrame, linked: DataFrame) -> DataFrame:
    """(qid, entity_hit): whether an expected entity (qid, entities) and the name of a linked
    one contain each other, whatever their case and spaces."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    want = questions.select("qid", F.filter(F.transform(F.coalesce("entities", F.array().cast("array<string>")), plain), lambda w: w != "").alias("want"))
    have = linked.groupBy("qid").agg(F.collect_set(plain(F.col("name"))).alias("have"))
    none = F.array().cast("array<string>")
    hit = F.exists("want", lambda w: F.exists(F.coalesce("have", none), lambda h: h.contains(w) | w.contains(h)))
    return want.join(have, "qid", "left").select("qid", hit.alias("entity_hit"))


def top_passages(passages: DataFrame, most: int = 5) -> DataFrame:
    """(qid, top): rank, meet, citation, kind and language of the first passages."""
    item = F.struct("rank", F.col("press_meet_id").alias("meet"), "citation", "source_type", "language")
    return passages.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("top"))


def score_answers(questions: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, chars, cited, invalid, uncited, refused, cited_expected_meet) of answers (qid,
    answer, cited, invalid, uncited, refused) with their sources (qid, n, press_meet_id)."""
    used = answers.select("qid", F.explode("cited").alias("n")).join(sources.select("qid", "n", "press_meet_id"), ["qid", "n"])
    want = questions.select("qid", F.explode("meets").alias("press_meet_id")).distinct()
    hit = used.join(want, ["qid", "press_meet_id"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(True))
    rows = answers.join(hit, "qid", "left")
    return rows.select("qid", F.length("answer").alias("chars"), F.size("cited").alias("cited"), F.size("invalid").alias("invalid"), "uncited", F.col("refused").isNotNull().alias("refused"), F.coalesce("hit", F.lit(False)).alias("cited_expected_meet"))


def type_counts(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(stage, source_type, n, longest): rows of each stage by kind, and their longest text."""
    one = lambda df, stage, key, text: df.select(key, "source_type", text).distinct().groupBy("source_type").agg(F.countDistinct(key).alias("n"), F.max(F.length(text)).alias("longest")).select(F.lit(stage).alias("stage"), "source_type", "n", "longest")
    return one(segments, "extract", "segment_id", "text_original").unionByName(one(chunks, "chunk", "chunk_id", "text"))


def yields(records: DataFrame, seconds: float) -> DataFrame:
    """One row over extraction records (content_hash, entities, relations, error, calls): what
    a configuration of a model yields."""
    n = F.count("*")
    return records.agg(n.alias("units"), F.round(n * 60 / F.lit(max(seconds, 1e-9)), 2).alias("units_per_minute"), F.round(F.avg("calls"), 2).alias("calls_per_unit"), F.round(F.avg(F.size("entities")), 2).alias("entities_per_unit"), F.round(F.avg(F.size("relations")), 2).alias("relations_per_unit"), F.round(F.count_if(F.col("error").isNull()) / n, 4).alias("share_without_error"))


def markdown(scores: list[dict], baseline: list[dict] | None = None, title: str = "Evaluation") -> str:
    """Aggregate scores as a table, with differences against those of a baseline."""
    before = {(r["kind"], r["lang"]): r for r in baseline or []}
    measures = ("meet_hit_rate", "mrr", "recall", "precision")

    def cell(r: dict, m: str) -> str:
        old = before.get((r["kind"], r["lang"]), {}).get(m)
        return f"{r[m]:.3f}" + ("" if old is None or r[m] == old else f" ({r[m] - old:+.3f})")

    rows = [f"| {r['kind']} | {r['lang']} | {r['n']} | " + " | ".join(cell(r, m) for m in measures) + " |" for r in sorted(scores, key=lambda r: (r["kind"] != "all" or r["lang"] != "all", r["kind"], r["lang"]))]
    return "\n".join([f"# {title}", "", f"| kind | language | n | {' | '.join(measures)} |", "|" + "---|" * 7, *rows, ""])
