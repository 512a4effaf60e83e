"""The graph leg: linking questions to entities, and turning edges into citable facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.operators.chunking import ngrams
from pressloom.operators.filters import Filters

STRUCTURAL_TYPES = ("PressMeet", "Source", "Publication", "Date")
LINK_LIMIT, EVIDENCE_LIMIT, MIN_STRUCTURAL_CHARS = 6, 2, 6
#: Fixed: order of relations by what they add to an answer.
PRIORITY = {"MAKES_CLAIM": 0, "ANNOUNCED_SCHEME": 1, "ACCUSES": 2, "SUPPORTS": 3, "OPPOSES": 3, "RESPONDS_TO": 3, "MEMBER_OF": 8, "MENTIONS": 9}


def name_index(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(surface, entity_id): every normalised name and alias of every node; ``aliases``
    (surface, canonical) adds the spellings of an ontology."""
    names = nodes.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    index = names.select(S.normalise(F.col("s")).alias("surface"), "entity_id")
    if aliases is not None:
        known = aliases.select(S.normalise(F.col("surface")).alias("surface"), S.normalise(F.col("canonical")).alias("canonical"))
        index = index.unionByName(known.join(index.select(F.col("surface").alias("canonical"), "entity_id"), "canonical").select("surface", "entity_id"))
    return index.where("surface <> ''").distinct()


def link_entities(questions: DataFrame, nodes: DataFrame, index: DataFrame, limit: int = LINK_LIMIT) -> DataFrame:
    """(qid, entity_id, matched, name, type, mention_count): the nodes a question names. A
    span inside a longer match is passed over; longest match first, then most mentioned."""
    spans = questions.select("qid", S.normalise(F.col("q")).alias("_n")).select("qid", F.explode(ngrams(F.col("_n"))).alias("s")).select("qid", "s.start", "s.end", F.col("s.text").alias("surface"))
    spans = spans.where(~F.col("surface").isin(*S.TOPIC_STOPWORDS))
    named = index.join(nodes.select("entity_id", "name", "type", "mention_count"), "entity_id")
    usable = named.where(~F.col("type").isin(*STRUCTURAL_TYPES) | (F.length("surface") >= MIN_STRUCTURAL_CHARS))
    hit = spans.join(usable.select("surface").distinct(), "surface", "left_semi")
    # greedy cover of one question's few matching spans, longest and leftmost first
    item = F.struct((F.col("start") - F.col("end")).alias("neg"), "start", "end", "surface")
    one = hit.groupBy("qid").agg(F.array_sort(F.collect_set(item)).alias("xs"))
    zero = F.array().cast("array<struct<neg:int,start:int,end:int,surface:string>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    kept = one.select("qid", F.explode(F.aggregate("xs", zero, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))).alias("x"))
    linked = kept.select("qid", F.col("x.surface").alias("surface")).join(usable, "surface").groupBy("qid", "entity_id").agg(
        F.max_by("surface", F.struct(F.length("surface"), "surface")).alias("matched"), F.min("name").alias("name"), F.min("type").alias("type"), F.max("mention_count").alias("mention_count")
    )
    w = Window.partitionBy("qid").orderBy(F.desc(F.length("matched")), F.desc("mention_count"), "entity_id")
    return linked.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def scope(edges: DataFrame, filters: Filters = Filters(), cap: int = EVIDENCE_LIMIT) -> DataFrame:
    """Edges as facts within filters: evidence that names a chunk and a file and passes, at
    most ``cap`` of it; meets and dates of that evidence; weight of all that passes. Edges
    without such evidence are no facts."""
    fits = F.filter(F.coalesce("evidence", F.array().cast(edges.schema["evidence"].dataType)), lambda e: (e["chunk_id"] != "") & (e["source_file"] != "") & filters.of(e))
    base = edges.withColumn("_fits", fits).where(F.size("_fits") > 0).withColumn("evidence", F.slice("_fits", 1, cap))
    dates = F.array_sort(F.filter(F.transform("evidence", lambda e: e["date"]), lambda d: d.isNotNull() & (d != "")))
    return base.select(
        "source_id", "relation", "target_id", "structural",
        F.size("_fits").alias("n_evidence"),
        (F.size("_fits") if filters.active else F.col("weight")).alias("weight"),
        F.array_sort(F.array_distinct(F.filter(F.transform("evidence", lambda e: e["press_meet_id"]), lambda m: m.isNotNull() & (m != "")))).alias("press_meet_ids"),
        F.get(dates, F.lit(0)).alias("first_date"),
        F.get(F.reverse(dates), F.lit(0)).alias("last_date"),
        "evidence",
    )


def topic_terms(normalised: Column) -> Column:
    """Distinct words of a normalised text that may decide a match."""
    stop = F.array(*map(F.lit, S.TOPIC_STOPWORDS))
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda t: (t != "") & ~F.array_contains(stop, t)))


def relevance(terms: Column, fact_terms: Column, in_meet: Column, structural: Column) -> Column:
    """Share of the question's terms in a fact, more where its meet was retrieved and where
    it is content; 0 without terms."""
    hits = F.size(F.array_intersect(terms, fact_terms))
    return F.when(F.size(terms) == 0, 0.0).otherwise(hits / F.size(terms) + F.when(in_meet, 0.5).otherwise(0.0) + F.when(structural, 0.0).otherwise(0.25))


def priority(relation: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, p in PRIORITY.items():
        out = out.when(relation == name, p)
    return out.otherwise(5)


def fact_order() -> list[Column]:
    return [F.col("hop"), F.desc("relevance"), F.col("structural"), priority(F.col("relation")), F.desc("weight"), F.col("source_id"), F.col("relation"), F.col("target_id")]


def gather(questions: DataFrame, linked: DataFrame, edges: DataFrame, nodes: DataFrame, passages: DataFrame | None = None, filters: Filters = Filters(), most: int = 20) -> DataFrame:
    """(qid, n, fact, hop, relevance): facts one hop from a question's entities. With terms
    and at least three facts on topic only those stay, else at most six; without terms the
    first by rank."""
    facts = scope(edges, filters)
    names = nodes.select(F.col("entity_id"), "name")
    ends = facts.join(names.withColumnsRenamed({"entity_id": "source_id", "name": "source"}), "source_id", "left").join(names.withColumnsRenamed({"entity_id": "target_id", "name": "target"}), "target_id", "left")
    touch = linked.select("qid", "entity_id", F.col("n").alias("entity_rank"))
    hit = ends.join(touch.withColumnRenamed("entity_id", "source_id"), "source_id").unionByName(ends.join(touch.withColumnRenamed("entity_id", "target_id"), "target_id"))
    once = hit.groupBy("qid", "source_id", "relation", "target_id").agg(F.min_by(F.struct(*[c for c in hit.columns if c not in ("qid", "source_id", "relation", "target_id")]), "entity_rank").alias("f")).select("qid", "source_id", "relation", "target_id", "f.*")
    matched = linked.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(F.split("matched", " ")))).alias("named"))
    asked = questions.select("qid", S.normalise(F.col("q")).alias("_n"))
    terms = asked.select("qid", topic_terms(F.col("_n")).alias("t")).join(matched, "qid", "left").select("qid", F.array_except("t", F.coalesce("named", F.array().cast("array<string>"))).alias("terms"))
    joined = once.join(terms, "qid").withColumn("hop", F.lit(1))
    if passages is not None:
        meets = passages.groupBy("qid").agg(F.collect_set("press_meet_id").alias("meets"))
        joined = joined.join(meets, "qid", "left").withColumn("in_meet", F.coalesce(F.arrays_overlap("press_meet_ids", "meets"), F.lit(False)))
    else:
        joined = joined.withColumn("in_meet", F.lit(False))
    body = F.concat_ws(" ", F.coalesce("source", "source_id"), "relation", F.coalesce("target", "target_id"), F.array_join(F.transform("evidence", lambda e: F.coalesce(e["quote"], F.lit(""))), " "))
    spoken = joined.withColumn("_body", S.normalise(body)).withColumn("_body", topic_terms(F.col("_body")))
    scored = spoken.withColumn("relevance", relevance(F.col("terms"), F.col("_body"), F.col("in_meet"), F.col("structural")))
    q = Window.partitionBy("qid")
    on = scored.withColumn("on_topic", (F.col("relevance") > 0.3) & (F.size("terms") > 0)).withColumn("n_on", F.sum(F.col("on_topic").cast("int")).over(q))
    kept = on.where((F.size("terms") == 0) | (F.col("n_on") < 3) | F.col("on_topic"))
    n = F.row_number().over(q.orderBy(*fact_order()))
    room = F.when((F.size("terms") > 0) & (F.col("n_on") < 3), F.least(F.lit(6), F.lit(most))).otherwise(F.lit(most))
    return kept.withColumn("n", n).where(F.col("n") <= room).drop("terms", "meets", "named", "_body")
