"""The knowledge graph as tables: building, describing and walking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.session import cut_lineage

EVIDENCE_CAP = 64
KEY = ("source_id", "relation", "target_id")


def merge_entities(observed: DataFrame, order: str = "seq") -> DataFrame:
    """One node per entity_id: name and type of the first observation, aliases and meets as
    sets, mentions summed, dates spanned, structural if any is."""
    return observed.groupBy("entity_id").agg(
        F.min_by("name", order).alias("name"),
        F.min_by("type", order).alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
        F.sum("mention_count").alias("mention_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("press_meet_ids", F.array().cast("array<string>")))))).alias("press_meet_ids"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.max("structural").alias("structural"),
    )


def collapse_relations(assertions: DataFrame, nodes: DataFrame | None = None, cap: int = EVIDENCE_CAP, order: str = "seq") -> DataFrame:
    """One edge per (source, relation, target): weight is the number of assertions, meets are
    a set, dates are spanned, evidence is the first ``cap`` distinct chunks. Assertions with an
    end that is no node are left out."""
    kept = assertions
    if nodes is not None:
        ids = nodes.select("entity_id").distinct()
        kept = kept.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    edges = kept.groupBy(*KEY).agg(
        F.count("*").cast("int").alias("weight"),
        F.min_by("structural", order).alias("structural"),
        F.array_sort(F.collect_set(F.when(F.col("press_meet_id") != "", F.col("press_meet_id")))).alias("press_meet_ids"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    once = kept.where("evidence.chunk_id is not null").withColumn("_copy", F.row_number().over(Window.partitionBy(*KEY, "evidence.chunk_id").orderBy(order))).where("_copy = 1")
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(order))).where(F.col("_n") <= cap)
    evidence = first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    return edges.join(evidence, list(KEY), "left")


def assertions_of(edges: DataFrame) -> DataFrame:
    """Edges taken apart into one assertion per evidence."""
    return edges.select(*KEY, "structural", F.posexplode("evidence").alias("seq", "evidence")).select(
        *KEY, "structural", "seq", "evidence", F.col("evidence.press_meet_id").alias("press_meet_id"), F.col("evidence.date").alias("date")
    )


def enrich_evidence(edges: DataFrame, locators: DataFrame) -> DataFrame:
    """Evidence with its empty fields filled from the chunk it names, and whether one was
    found: (source_id, relation, target_id, seq, resolved, evidence fields)."""
    fields = ("source_file", "citation", "press_meet_id", "date", "source_type", "publication", "language")
    numbers = ("page", "slide", "video_start", "video_end")
    ev = edges.select(*KEY, F.posexplode("evidence").alias("seq", "e")).select(*KEY, "seq", "e.chunk_id", "e.quote", *[F.col(f"e.{f}").alias(f) for f in fields + numbers])
    own = locators.groupBy("chunk_id").agg(*[F.min(f).alias(f"_{f}") for f in fields + numbers])
    filled = ev.join(own.withColumn("_found", F.lit(True)), "chunk_id", "left")
    text = [F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_{f}"), F.col(f)).alias(f) for f in fields]
    number = [F.coalesce(F.when(F.col(f) != 0, F.col(f)), F.col(f"_{f}"), F.col(f)).alias(f) for f in numbers]
    return filled.select(*KEY, "seq", "chunk_id", "quote", F.coalesce("_found", F.lit(False)).alias("resolved"), *text, *number)


def structural_meets(chunks: DataFrame) -> DataFrame:
    """Per meet: title, topic, chunks, files and first date. Meet, title and topic of a file
    are those of its first chunk."""
    once = chunks.dropDuplicates(["chunk_id"])
    head = once.groupBy("source_file").agg(
        F.min_by(F.struct("press_meet_id", "press_meet_title", "topic"), "chunk_id").alias("h"), F.count("*").alias("n"), F.min(F.when(F.col("date") != "", F.col("date"))).alias("date")
    )
    meet = F.coalesce(F.when(F.col("h.press_meet_id") != "", F.col("h.press_meet_id")), F.lit("unknown"))
    return head.groupBy(meet.alias("press_meet_id")).agg(
        F.coalesce(F.min_by("h.press_meet_title", "source_file"), F.lit("")).alias("title"),
        F.coalesce(F.min_by(F.col("h.topic"), F.when(F.col("h.topic") != "", F.col("source_file"))), F.lit("")).alias("topic"),
        F.sum("n").alias("chunk_count"),
        F.count("*").alias("file_count"),
        F.min("date").alias("first_date"),
    )


def structural_edges(chunks: DataFrame) -> DataFrame:
    """HELD_ON, CITES_SOURCE and COVERED_BY edges that file metadata asserts."""
    once = chunks.dropDuplicates(["chunk_id"])
    files = once.groupBy("source_file").agg(F.min_by(F.struct("press_meet_id", "publication"), "chunk_id").alias("h"), F.min(F.when(F.col("date") != "", F.col("date"))).alias("date"))
    meet = F.concat(F.lit("PressMeet:"), F.coalesce(F.when(F.col("h.press_meet_id") != "", F.col("h.press_meet_id")), F.lit("unknown")))
    flat = files.select(meet.alias("source_id"), "source_file", F.col("h.publication").alias("publication"), "date")
    held = flat.groupBy("source_id").agg(F.min("date").alias("d")).where("d is not null").select("source_id", F.lit("HELD_ON").alias("relation"), F.concat(F.lit("Date:"), "d").alias("target_id"))
    cites = flat.select("source_id", F.lit("CITES_SOURCE").alias("relation"), F.concat(F.lit("Source:"), "source_file").alias("target_id"))
    covered = flat.where("publication <> ''").select("source_id", F.lit("COVERED_BY").alias("relation"), F.concat(F.lit("Publication:"), "publication").alias("target_id"))
    return held.unionByName(cites).unionByName(covered).groupBy(*KEY).agg(F.count("*").cast("int").alias("weight"))


def precedes(meets: DataFrame) -> DataFrame:
    """Dated meets chained by date; undated ones stay out. Meets are few and known in number,
    so the one ordered window is over them only."""
    w = Window.orderBy("first_date", "press_meet_id")
    chain = meets.where("first_date is not null").select("press_meet_id", "first_date", F.lead("press_meet_id").over(w).alias("next_id"))
    return chain.where("next_id is not null")


def undirected(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(u, v, weight) with u < v: loops dropped, parallel and reverse edges summed."""
    return edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).agg(F.sum(weight).alias("weight"))


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by type and of edges by relation."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    )


def legal_triples(ontology: dict[str, tuple[list[str], list[str]]], spark) -> DataFrame:
    """(relation, source_type, target_type) of an ontology relation -> (from, to)."""
    rows = [(r, a, b) for r, (sources, targets) in ontology.items() for a in sources for b in targets]
    return spark.createDataFrame(rows, "relation string, source_type string, target_type string")


def typed(edges: DataFrame) -> DataFrame:
    """Edges with the types their ids carry."""
    kind = lambda c: F.substring_index(F.col(c), ":", 1)
    return edges.withColumn("source_type", kind("source_id")).withColumn("target_type", kind("target_id"))


def valid_edges(edges: DataFrame, triples: DataFrame, invert: bool = False) -> DataFrame:
    """Edges the ontology allows, or those it does not; the ontology is a declared table."""
    return typed(edges).join(F.broadcast(triples), ["relation", "source_type", "target_type"], "left_anti" if invert else "left_semi")


def find_entities(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Nodes by exact id, exact name, then part of a name or alias, most mentioned first."""
    q = query.strip().lower()
    name = F.lower("name")
    part = name.contains(q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q))
    tier = F.when(F.lower("entity_id") == q, 0).when(name == q, 1).when(part, 2)
    hit = nodes.withColumn("tier", tier).where("tier is not null")
    if kind:
        hit = hit.where(F.col("type") == kind)
    return hit.orderBy("tier", F.desc("mention_count"), "entity_id").limit(limit)


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, relations: list[str] | None = None) -> DataFrame:
    """(seed, hop, source_id, relation, target_id, weight): edges within hops of each seed
    (seed), each at its lowest hop, in either direction. A relation filter also stops the
    walk. Frontiers and seen nodes stay tables; nothing comes to the driver."""
    kept = edges.where(F.col("relation").isin(*relations)) if relations else edges
    kept = kept.select(*KEY, "weight")
    both = kept.withColumn("at", F.col("source_id")).withColumn("to", F.col("target_id")).unionByName(kept.withColumn("at", F.col("target_id")).withColumn("to", F.col("source_id")))
    frontier = seen = seeds.select("seed", F.col("seed").alias("at")).distinct()
    out = None
    for hop in range(1, hops + 1):
        step = frontier.join(both, "at").withColumn("hop", F.lit(hop))
        found = step.select("seed", "hop", *KEY, "weight").distinct()
        out = found if out is None else out.unionByName(found)
        if hop < hops:
            frontier = step.select("seed", F.col("to").alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")
            seen = cut_lineage(seen.unionByName(frontier))
            frontier = cut_lineage(frontier)
    return out.groupBy("seed", *KEY).agg(F.min("hop").alias("hop"), F.max("weight").alias("weight"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 4, limit: int = 5) -> DataFrame:
    """(a, b, hops, path): the first ``limit`` simple paths of at most cutoff hops between each
    pair, shortest first. Walks that cannot reach the goal in the hops left are dropped by a
    reverse search first, so hubs are not enumerated; pairs that have ``limit`` paths go no further."""
    links = undirected(edges).select("u", "v")
    step = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    goal = pairs.select("b").distinct().select(F.col("b"), F.col("b").alias("node"), F.lit(0).alias("left"))
    reach, front = goal, goal
    for d in range(1, cutoff + 1):
        front = front.join(step, front.node == step.u).select("b", F.col("v").alias("node")).distinct().join(reach, ["b", "node"], "left_anti").withColumn("left", F.lit(d))
        front = cut_lineage(front)
        reach = reach.unionByName(front)
    reach = cut_lineage(reach)
    walks = pairs.select("a", "b", F.array("a").alias("path"), F.col("a").alias("node"))
    done = None
    for d in range(1, cutoff + 1):
        grown = walks.join(step, walks.node == step.u).where(~F.array_contains("path", F.col("v"))).select("a", "b", F.concat("path", F.array("v")).alias("path"), F.col("v").alias("node"))
        near = grown.join(reach.where(F.col("left") <= cutoff - d), ["b", "node"], "left_semi")
        near = cut_lineage(near)
        hit = near.where("node = b").select("a", "b", F.lit(d).alias("hops"), "path")
        done = hit if done is None else done.unionByName(hit)
        full = done.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        walks = near.where("node <> b").join(full, ["a", "b"], "left_anti")
    w = Window.partitionBy("a", "b").orderBy("hops", "path")
    return done.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n, hop, source_id, relation, target_id, weight): the heaviest real edge of every
    hop of paths (a, b, n, path), in the path's direction where there is one."""
    best = edges.groupBy("source_id", "target_id").agg(F.min_by(F.struct("relation", "weight"), F.struct(-F.col("weight"), "relation")).alias("e")).select("source_id", "target_id", "e.*")
    hops = paths.select("a", "b", "n", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v"))).alias("hop", "h")).select("a", "b", "n", (F.col("hop") + 1).alias("hop"), "h.u", "h.v")
    along = best.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), F.lit(0).alias("back"), "source_id", "relation", "target_id", "weight")
    against = best.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"), F.lit(1).alias("back"), "source_id", "relation", "target_id", "weight")
    found = hops.join(along.unionByName(against), ["u", "v"])
    return found.groupBy("a", "b", "n", "hop").agg(F.min_by(F.struct("source_id", "relation", "target_id", "weight"), "back").alias("e")).select("a", "b", "n", "hop", "e.*")


def timeline(nodes: DataFrame, edges: DataFrame, meets: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, press_meet_id, date, title): meets of each seed and of its edges, undated last."""
    own = nodes.join(seeds.select(F.col("seed").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("seed"), F.explode("press_meet_ids").alias("press_meet_id"))
    touch = lambda c: edges.join(seeds.select(F.col("seed").alias(c)), c, "left_semi").select(F.col(c).alias("seed"), F.explode("press_meet_ids").alias("press_meet_id"))
    ids = own.unionByName(touch("source_id")).unionByName(touch("target_id")).distinct()
    return ids.join(meets.select("press_meet_id", "date", F.col("press_meet_title").alias("title")), "press_meet_id", "left")


def communities(links: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community): weighted label propagation with deterministic ties.

    Every round a node takes the label of the greatest total weight among its neighbours and
    itself, least label on ties; half of the nodes, by hash and round, move at a time so that
    pairs do not swap for ever. Stops when no label changes."""
    both = cut_lineage(links.select("u", "v", "weight").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    label = cut_lineage(both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")))
    quiet = 0
    for r in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("u").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("best"), F.max("w").alias("w"))
        held = votes.select(F.col("u").alias("node"), "community", F.col("w").alias("own"))
        moved = label.join(best.withColumnRenamed("u", "node"), "node").join(held, ["node", "community"], "left")
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)) + r, F.lit(2)) == 0
        better = turn & (F.col("w") > F.coalesce("own", F.lit(0)))
        label = cut_lineage(moved.select("node", F.when(better, F.col("best")).otherwise(F.col("community")).alias("community"), better.alias("moved")))
        changed = label.where("moved").limit(1).count()
        label = label.drop("moved")
        quiet = 0 if changed else quiet + 1
        if quiet >= 2:
            break
    return label


def number_communities(label: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community_id, size, node): communities named c0000... by size, isolated nodes alone."""
    every = nodes.select(F.col("entity_id").alias("node")).distinct().join(label, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    sizes = every.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    # global rank without one task holding all: by size bucket first
    bucket = sizes.groupBy("size").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("size").orderBy("first"))
    named = sizes.withColumn("_r", within).join(bucket.select("size", "before"), "size").withColumn("community_id", F.format_string("c%04d", F.col("before") + F.col("_r") - 1))
    return every.join(named.select("community", "community_id", "size"), "community").select("community_id", "size", "node")


def modularity(links: DataFrame, label: DataFrame) -> DataFrame:
    """One row: modularity of a labelling of an undirected weighted graph."""
    a, b = label.withColumnsRenamed({"node": "u", "community": "cu"}), label.withColumnsRenamed({"node": "v", "community": "cv"})
    m = links.agg(F.sum("weight").alias("m"))
    inside = links.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("inside"))
    ends = links.select(F.col("u").alias("node"), "weight").unionByName(links.select(F.col("v").alias("node"), "weight"))
    degree = ends.join(label, "node").groupBy("community").agg(F.sum("weight").alias("degree"))
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return degree.join(inside, "community", "left").crossJoin(F.broadcast(m)).agg(F.sum(q).alias("modularity"))  # m is one row


def briefs(label: DataFrame, nodes: DataFrame, edges: DataFrame, members: int = 40, relations: int = 60) -> DataFrame:
    """Per community: its most mentioned members and its heaviest inner edges."""
    own = label.join(nodes.select(F.col("entity_id").alias("node"), "name", "type", "mention_count"), "node")
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("mention_count"), "node"))).where(F.col("r") <= members)
    people = top.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("members"))
    where = label.select("node", "community_id")
    inner = edges.where(~F.col("structural")).join(where.withColumnsRenamed({"node": "source_id", "community_id": "c1"}), "source_id").join(where.withColumnsRenamed({"node": "target_id", "community_id": "c2"}), "target_id").where("c1 = c2")
    heavy = inner.withColumn("r", F.row_number().over(Window.partitionBy("c1").orderBy(F.desc("weight"), *KEY))).where(F.col("r") <= relations)
    lines = heavy.groupBy(F.col("c1").alias("community_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", *KEY).alias("line")))), lambda x: x["line"]).alias("relations"))
    return people.join(lines, "community_id", "left")


def top_entities(nodes: DataFrame, kind: str | None = None, most: int = 20) -> DataFrame:
    """The most mentioned nodes, of one type where it is given."""
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    return rows.orderBy(F.desc("mention_count"), "name", "entity_id").limit(most)


def community_list(community: DataFrame, least: int = 1) -> DataFrame:
    """(community_id, size) of communities (community_id, size, node) of at least a size."""
    return community.where(F.col("size") >= least).select("community_id", "size").distinct()


def load_records(chunks: DataFrame, records: DataFrame, known: DataFrame, stated: DataFrame, canonical: DataFrame, triples: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(observed entities, assertions) of cached extraction records, for merge_entities and
    collapse_relations.

    Every entity (content_hash, key, name, type) of a chunk's content is one observation under
    its canonical name (type, key, display), and its press meet MENTIONS it where the ontology
    allows that; an issue is also what the meet is ABOUT_ISSUE and the chunk's source
    RELATED_TO_ISSUE. Relations (content_hash, source_id, relation, target_id, evidence) come
    with the chunk they stand in. Entities of fewer than ``least`` mentions are left out."""
    own = chunks.withColumn("content_hash", F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("chunk_id"))).join(records.select("content_hash").distinct(), "content_hash", "left_semi")
    own = own.select("content_hash", "chunk_id", "source_file", F.coalesce(F.when(F.col("press_meet_id") != "", F.col("press_meet_id")), F.lit("unknown")).alias("press_meet_id"), "date", "citation")
    named = known.where("issue is null").select("content_hash", "type", "key", "name").join(canonical.select("type", "key", "display"), ["type", "key"], "left").withColumn("display", F.coalesce("display", "name"))
    ids = named.withColumn("entity_id", F.concat_ws(":", "type", S.normalise(F.col("display"))))
    seen = own.join(ids, "content_hash")
    kept = seen.join(seen.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("entity_id"), "entity_id", "left_semi") if least > 1 else seen
    alias = F.when(S.normalise(F.col("name")) != S.normalise(F.col("display")), F.array("name")).otherwise(F.array().cast("array<string>"))
    observed = kept.select("entity_id", F.col("display").alias("name"), "type", alias.alias("aliases"), F.lit(1).alias("mention_count"), F.array("press_meet_id").alias("press_meet_ids"), F.col("date").alias("first_date"), F.col("date").alias("last_date"), F.lit(False).alias("structural"), F.col("chunk_id").alias("seq"))
    evidence = lambda quote: F.struct("chunk_id", quote.alias("quote"), "source_file", "citation", "press_meet_id", "date").alias("evidence")
    row = lambda df, a, r, b, q: df.select(a.alias("source_id"), r.alias("relation"), b.alias("target_id"), F.lit(False).alias("structural"), F.col("chunk_id").alias("seq"), evidence(q), "press_meet_id", "date")
    meet, none = F.concat(F.lit("PressMeet:"), F.col("press_meet_id")), F.lit("")
    allowed = triples.where("relation = 'MENTIONS' and source_type = 'PressMeet'").select(F.col("target_type").alias("type")).distinct()
    issues = kept.where("type = 'Issue'")
    asserted = row(kept.join(F.broadcast(allowed), "type", "left_semi"), meet, F.lit("MENTIONS"), F.col("entity_id"), none)  # the ontology is declared
    asserted = asserted.unionByName(row(issues, meet, F.lit("ABOUT_ISSUE"), F.col("entity_id"), none)).unionByName(row(issues, F.concat(F.lit("Source:"), F.col("source_file")), F.lit("RELATED_TO_ISSUE"), F.col("entity_id"), none))
    spelled = ids.select("content_hash", F.concat_ws(":", "type", "key").alias("surface"), "entity_id")
    ends = stated.where("issue is null").join(spelled.withColumnsRenamed({"surface": "source_id", "entity_id": "_a"}), ["content_hash", "source_id"]).join(spelled.withColumnsRenamed({"surface": "target_id", "entity_id": "_b"}), ["content_hash", "target_id"])
    said = own.join(ends.select("content_hash", "_a", "relation", "_b", F.col("evidence").alias("_q")), "content_hash")
    return observed, asserted.unionByName(row(said, F.col("_a"), F.col("relation"), F.col("_b"), F.col("_q")))


def save(nodes: DataFrame, edges: DataFrame, community: DataFrame, folder: str) -> None:
    """The graph as three tables of a folder, each replaced."""
    for name, df in (("nodes", nodes), ("edges", edges), ("communities", community)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
