"""Hybrid retrieval as one plan: lexical, vector and graph legs, fusion, re-ranking,
duplicates, diversity, and what each leg found."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.operators import facts as J
from pressloom.operators import graph as G
from pressloom.operators import ranking as R
from pressloom.operators.filters import Filters
from pressloom.session import cut_lineage, partitions

FIELDS = ("chunk_id", "text", "citation", "source_type", "source_file", "content_hash", "press_meet_id", "date", "language")
TIMELINE, COMMUNITIES, MEMBERS = 15, 3, 8
#: Fixed: words that ask for an order of events.
TEMPORAL = r"(?i)\b(?:when|timeline|over time|chronolog|history|first|latest|since|before|after|evolv|progress)\b|ఎప్పుడు|కాలక్రమ"


def _once(chunks: DataFrame, filters: Filters) -> DataFrame:
    return filters.apply(chunks).select(*FIELDS).repartition(partitions(chunks.sparkSession), "chunk_id").dropDuplicates(["chunk_id"])


def legs(
    chunks: DataFrame, questions: DataFrame, reach: int, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, index: DataFrame | None = None, filters: Filters = Filters(), stats: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The passage legs that can run, each (qid, chunk_id, score, rank). Both look only at
    chunks that pass the filters; ``index`` are the postings of all chunks where they were
    written before, else they are made here."""
    passing = filters.apply(chunks).select("chunk_id").distinct()
    if index is None:
        index, stats = R.postings(_once(chunks, filters)), None
    elif filters.active:
        index, stats = index.drop("df").join(passing, "chunk_id", "left_semi"), None
    out = {"keyword": R.bm25(index, questions, reach, stats)}
    if vectors is not None and question_vectors is not None:
        R.check_dimension(vectors, question_vectors)
        if filters.active:
            vectors = vectors.join(passing, "chunk_id", "left_semi")
        out["vector"] = R.vector_topk(vectors, question_vectors, reach)
    return out


def passages(
    chunks: DataFrame, questions: DataFrame, k: int = 8, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, filters: Filters = Filters(), rerank: bool = True, weights: tuple[float, float] = (1.0, 1.0), index: DataFrame | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """(qid, rank, chunk_id, score, ranks, ...): the k passages of each question (qid, q).

    The legs over-fetch, as copies are collapsed later. Without vectors the lexical leg ranks
    alone. Repeated chunk rows count once; chunks without text are found by no leg.
    """
    return ordered(chunks, questions, k, legs(chunks, questions, k * R.OVERFETCH, vectors, question_vectors, index, filters, stats), filters, rerank, weights)


def ordered(chunks: DataFrame, questions: DataFrame, k: int, found: dict[str, DataFrame], filters: Filters = Filters(), rerank: bool = True, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The k passages of each question out of what the legs found."""
    return with_texts(placed(chunks, questions, k, found, filters, rerank, weights), chunks, questions, filters)


def with_texts(rows: DataFrame, chunks: DataFrame, questions: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Placed passages with the fields of their chunks and their questions."""
    own = [c for c in FIELDS if c == "chunk_id" or c not in rows.columns]
    return rows.join(_once(chunks, filters).select(*own), "chunk_id").join(questions.select("qid", "q"), "qid")


def placed(chunks: DataFrame, questions: DataFrame, k: int, found: dict[str, DataFrame], filters: Filters = Filters(), rerank: bool = True, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The k passages of each question without their texts, which are long and stand in many
    questions: what ranking asks of a text is taken where it lies. Rows also say how many
    chunks each leg found for their question, as n_ and the leg's name."""
    reach, own = k * R.OVERFETCH, dict(zip(("vector", "keyword"), weights))
    asked = questions.select("qid", R.intent(F.col("q")).alias("rerank_intent"), S.query_terms(F.col("q")).alias("_terms"))
    facts = _once(chunks, filters).select("chunk_id", "source_type", "source_file", "content_hash", "citation", R.own_terms().alias("_own"))
    hits = reduce(DataFrame.unionByName, [df.select("qid", "chunk_id", F.lit(name).alias("leg"), "rank", F.lit(float(own[name])).alias("weight")) for name, df in found.items()])
    rows = hits.join(asked, "qid").join(facts, "chunk_id").withColumn("source_prior", R.prior(F.col("rerank_intent"), F.col("source_type"))).withColumn("_coverage", R.coverage(F.col("_terms"), F.col("_own")))
    more = ["source_file", "content_hash", "citation", *(["rerank_intent", "source_prior", "_coverage"] if rerank else [])]
    # everything from here on is by question
    fused = R.fused(rows.select("qid", "chunk_id", "leg", "rank", "weight", *more).repartition("qid"), *more)
    scored = R.weighed(fused) if rerank else fused
    q = Window.partitionBy("qid")
    counted = scored.withColumns({f"n_{name}": F.count_if(F.map_contains_key("ranks", name)).over(q) for name in found})
    ordered_ = counted.withColumn("pos", F.row_number().over(q.orderBy(F.desc("score"), "chunk_id")))
    # every copy is collapsed before the cut, so that the cut counts contents
    return R.diversify(R.dedup(ordered_, 2 * reach), k).withColumnRenamed("pos", "rank").drop("citation")


@dataclass
class Context:
    """Everything an answer may be written from, by qid."""

    passages: DataFrame
    entities: DataFrame
    facts: DataFrame
    communities: DataFrame
    timeline: DataFrame
    diagnostics: DataFrame


def asks_for_order(question: Column) -> Column:
    return question.rlike(TEMPORAL)


def timelines(questions: DataFrame, linked: DataFrame, nodes: DataFrame, edges: DataFrame, meets: DataFrame, most: int = TIMELINE) -> DataFrame:
    """(qid, n, press_meet_id, date, title): the meets of a question's first entity, in their
    order, where it asks for an order of events or the entity was at more than one meet."""
    head = linked.where("n = 1").select("qid", "entity_id").join(nodes.select("entity_id", F.size(F.coalesce("press_meet_ids", F.array().cast("array<string>"))).alias("meets")), "entity_id")
    asked = head.join(questions, "qid").where(asks_for_order(F.col("q")) | (F.col("meets") > 1)).select("qid", F.col("entity_id").alias("seed"))
    rows = G.timeline(nodes, edges, meets, asked.select("seed").distinct())
    return R.ranked(asked.join(rows, "seed"), most, F.asc_nulls_last("date"), F.col("press_meet_id")).select("qid", F.col("rank").alias("n"), "press_meet_id", "date", "title")


def communities_of(linked: DataFrame, community: DataFrame, nodes: DataFrame, most: int = COMMUNITIES, members: int = MEMBERS) -> DataFrame:
    """(qid, n, community_id, size, members): the largest communities (community_id, size,
    node) of a question's entities, with the names of their first members."""
    hit = linked.select("qid", F.col("entity_id").alias("node")).join(community, "node").select("qid", "community_id", "size").distinct()
    top = R.ranked(hit, most, F.desc("size"), F.col("community_id"))
    named = community.join(top.select("community_id").distinct(), "community_id", "left_semi").join(nodes.select(F.col("entity_id").alias("node"), "name"), "node")
    first = R.ranked(named, members, F.col("node"), by="community_id").groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("members"))
    return top.join(first, "community_id", "left").select("qid", F.col("rank").alias("n"), "community_id", "size", "members")


def retrieve(
    chunks: DataFrame, questions: DataFrame, nodes: DataFrame, edges: DataFrame, meets: DataFrame, k: int = 12, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, community: DataFrame | None = None, filters: Filters = Filters(), index: DataFrame | None = None, max_facts: int = 20, stats: DataFrame | None = None
) -> Context:
    """All legs for a batch of questions. A leg without its tables is left out and shows in
    the diagnostics as null; vectors of another dimension raise. Places of passages, entities
    and facts are written once, as everything after them reads them again; texts are not."""
    legs_ = legs(chunks, questions, k * R.OVERFETCH, vectors, question_vectors, index, filters, stats)
    at = cut_lineage(placed(chunks, questions, k, legs_, filters))
    found = with_texts(at, chunks, questions, filters)
    linked = cut_lineage(J.link_entities(questions, nodes, J.name_index(nodes)))
    facts = cut_lineage(J.gather(questions, linked, edges, nodes, found, filters, max_facts))
    named = communities_of(linked, community, nodes) if community is not None else linked.limit(0).select("qid", "n", F.lit("").alias("community_id"), F.lit(0).cast("bigint").alias("size"), F.array().cast("array<string>").alias("members"))
    count = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    some = lambda name: F.when(F.max(name) > 0, F.max(name)).alias(name)
    own = at.groupBy("qid").agg(*[some(f"n_{name}") for name in legs_], F.count("*").alias("n_passages"), F.min_by("rerank_intent", "rank").alias("intent"))
    diagnostics = questions.select("qid").join(own, "qid", "left")
    for df in (count(linked, "n_entities"), count(facts, "n_facts")):
        diagnostics = diagnostics.join(df, "qid", "left")
    if "n_vector" not in diagnostics.columns:
        diagnostics = diagnostics.withColumn("n_vector", F.lit(None).cast("bigint"))
    return Context(found, linked, facts, named, timelines(questions, linked, nodes, edges, meets), diagnostics)
