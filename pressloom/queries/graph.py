"""The knowledge graph: building, checking, describing and walking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.operators import extraction as X
from pressloom.operators import graph as G
from pressloom.operators.components import connected_components
from pressloom.functions.text import SPACE_RE2
from pressloom.queries.documents import norm
from pressloom.sources.tables import table

#: The archive's ontology: relation -> (from, to).
ONTOLOGY = {
    "MENTIONS": (["PressMeet"], ["Person", "Organization", "Place", "Scheme"]),
    "ANNOUNCED_SCHEME": (["Person"], ["Scheme"]),
    "ACCUSES": (["Person"], ["Person", "Organization"]),
    "LOCATED_IN": (["Place", "Organization"], ["Place"]),
}


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "edges")


def _nodes(spark, d) -> DataFrame:
    own = table(spark, d, "entities", "entity_id", "name", "type", "aliases", "mention_count", "press_meet_ids")
    meets = table(spark, d, "press_meets", "entity_id", "press_meet_title", "press_meet_id").select(
        "entity_id", F.col("press_meet_title").alias("name"), F.lit("PressMeet").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("mention_count"), F.array("press_meet_id").alias("press_meet_ids")
    )
    return own.unionByName(meets)


def merged_entities(spark, d) -> DataFrame:
    """Rows whose types and normalised names agree become one node."""
    return _merged(table(spark, d, "entities"))


def _merged(entities: DataFrame) -> DataFrame:
    e = entities.withColumn("seq", F.col("entity_id"))
    named = e.withColumn("entity_id", F.concat_ws(":", "type", S.normalise(F.col("name"))))
    m = G.merge_entities(named)
    return m.select("entity_id", "name", "type", F.size("aliases").alias("n_aliases"), "mention_count", F.size("press_meet_ids").alias("n_meets"), "first_date", "last_date", "structural")


def collapsed_relations(spark, d) -> DataFrame:
    return _collapsed(spark, d, cap=G.EVIDENCE_CAP)


def _collapsed(spark, d, cap: int) -> DataFrame:
    a = G.assertions_of(_edges(spark, d))
    c = G.collapse_relations(a, _nodes(spark, d), cap=cap)
    return c.select(*G.KEY, "weight", F.array_join("press_meet_ids", ",").alias("meets"), "first_date", "last_date", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), F.get("evidence", F.lit(0))["chunk_id"].alias("first_chunk"))


def enriched_evidence(spark, d) -> DataFrame:
    loc = table(spark, d, "chunks", "chunk_id", "source_file", "citation", "press_meet_id", "date", "source_type", "publication", "language", "page", "slide", "video_start", "video_end")
    return G.enrich_evidence(_edges(spark, d), loc).select(*G.KEY, "seq", "chunk_id", "resolved", "citation", "page", "source_file")


def structural_meets(spark, d) -> DataFrame:
    return G.structural_meets(table(spark, d, "chunks", "chunk_id", "source_file", "press_meet_id", "press_meet_title", "topic", "date"))


def structural_edges(spark, d) -> DataFrame:
    return G.structural_edges(table(spark, d, "chunks", "chunk_id", "source_file", "press_meet_id", "publication", "date"))


def precedes_chain(spark, d) -> DataFrame:
    return G.precedes(structural_meets(spark, d))


def ontology_valid(spark, d) -> DataFrame:
    return G.valid_edges(_edges(spark, d), G.legal_triples(ONTOLOGY, spark)).groupBy("relation").agg(F.count("*").alias("n"))


def ontology_rejects(spark, d) -> DataFrame:
    return G.valid_edges(_edges(spark, d), G.legal_triples(ONTOLOGY, spark), invert=True).groupBy("relation", "source_type", "target_type").agg(F.count("*").alias("n"))


def undirected_projection(spark, d) -> DataFrame:
    return G.undirected(_edges(spark, d))


def graph_describe(spark, d) -> DataFrame:
    return G.describe(_nodes(spark, d), _edges(spark, d))


def graph_components(spark, d) -> DataFrame:
    e = _edges(spark, d).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return connected_components(e).groupBy("component").agg(F.count("*").alias("n"))


def communities(spark, d) -> DataFrame:
    return G.number_communities(G.communities(G.undirected(_edges(spark, d))), _nodes(spark, d))


def community_modularity(spark, d) -> DataFrame:
    links = G.undirected(_edges(spark, d))
    return G.modularity(links, G.communities(links))


def community_briefs(spark, d) -> DataFrame:
    b = G.briefs(communities(spark, d).where("size >= 3"), _nodes(spark, d), _edges(spark, d))
    return b.select("community_id", F.size("members").alias("n_members"), F.array_join(F.slice("members", 1, 3), "; ").alias("leading"), F.coalesce(F.size("relations"), F.lit(0)).alias("n_relations"))


def find_entity(spark, d) -> DataFrame:
    return G.find_entities(table(spark, d, "entities", "entity_id", "name", "type", "aliases", "mention_count"), "power", kind="Organization", limit=20).select("entity_id", "name", "tier", "mention_count")


def _seeds(spark, d) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "type").where("type = 'Scheme'").select(F.col("entity_id").alias("seed"))


def neighbours_one(spark, d) -> DataFrame:
    return G.neighbours(_edges(spark, d), _seeds(spark, d), 1)


def neighbours_two(spark, d) -> DataFrame:
    return G.neighbours(_edges(spark, d), _seeds(spark, d), 2)


def neighbours_mentions(spark, d) -> DataFrame:
    return G.neighbours(_edges(spark, d), _seeds(spark, d), 2, relations=["MENTIONS", "ACCUSES"])


def _paths(spark, d) -> DataFrame:
    """Paths between all pairs of press meets, with the operator's own cutoff and limit."""
    meets = table(spark, d, "press_meets", "entity_id").distinct()
    pairs = meets.select(F.col("entity_id").alias("a")).join(meets.select(F.col("entity_id").alias("b")), F.col("a") < F.col("b"))
    return G.shortest_paths(_edges(spark, d), pairs)


def shortest_paths(spark, d) -> DataFrame:
    return _paths(spark, d).select("a", "b", "n", "hops", F.array_join("path", " > ").alias("path"))


def path_edges(spark, d) -> DataFrame:
    return G.path_edges(_paths(spark, d), _edges(spark, d)).select("a", "b", "n", "hop", "source_id", "relation", "target_id")


def timeline(spark, d) -> DataFrame:
    return G.timeline(_nodes(spark, d), _edges(spark, d), table(spark, d, "press_meets"), _seeds(spark, d))


def resolved_exactly(spark, d) -> DataFrame:
    r = X.resolve(table(spark, d, "entities", "entity_id", "type", "name", "mention_count"))
    return r.groupBy("display").agg(F.count("*").alias("n"))


def extraction_pieces(spark, d) -> DataFrame:
    p = X.pieces(table(spark, d, "chunks", "chunk_id", "text").distinct())
    return p.select("chunk_id", "piece_id", "content_hash")


def top_entities(spark, d) -> DataFrame:
    return G.top_entities(table(spark, d, "entities", "entity_id", "name", "type", "mention_count").where("name is not null"), "Person", 25).select("entity_id", "name", "mention_count")


QUERIES = {
    "top_entities": top_entities,
    "resolve_entities": resolved_exactly, "extraction_pieces": extraction_pieces,
    "entity_upsert": merged_entities, "relation_collapse": collapsed_relations, "evidence_enriched": enriched_evidence, "structural_meets": structural_meets, "structural_edges": structural_edges, "precedes_chain": precedes_chain, "ontology_valid": ontology_valid,
    "ontology_rejects": ontology_rejects, "undirected_projection": undirected_projection, "graph_describe": graph_describe, "entity_resolution_cc": graph_components, "communities": communities, "community_modularity": community_modularity, "community_brief": community_briefs,
    "find_entity": find_entity, "neighbors_1hop": neighbours_one, "neighbors_2hop": neighbours_two, "neighbors_filtered": neighbours_mentions, "shortest_paths": shortest_paths, "path_edges": path_edges, "timeline": timeline,
}

_EV = "ev AS (SELECT source_id, relation, target_id, e.seq, e.x AS x FROM (SELECT source_id, relation, target_id, unnest([{'seq': i - 1, 'x': evidence[i]} for i in range(1, len(evidence) + 1)]) AS e FROM edges))"
_TRIPLES = ", ".join(f"('{r}', '{a}', '{b}')" for r, (s, t) in ONTOLOGY.items() for a in s for b in t)
_TYPED = "SELECT *, string_split(source_id, ':')[1] AS source_type, string_split(target_id, ':')[1] AS target_type FROM edges"
_ONCE = "SELECT DISTINCT chunk_id, source_file, press_meet_id, press_meet_title, topic, publication, date FROM chunks"
_HEAD = f"h AS (SELECT source_file, arg_min(press_meet_id, chunk_id) AS meet, arg_min(press_meet_title, chunk_id) AS title, arg_min(topic, chunk_id) AS topic, count(*) AS n, min(nullif(date, '')) AS date FROM ({_ONCE}) GROUP BY 1)"
_MEETS = f"WITH {_HEAD} SELECT coalesce(nullif(meet, ''), 'unknown') AS press_meet_id, coalesce(arg_min(title, source_file), '') AS title, coalesce(arg_min(topic, source_file) FILTER (topic <> ''), '') AS topic, sum(n)::BIGINT AS chunk_count, count(*) AS file_count, min(date) AS first_date FROM h GROUP BY 1"
_BOTH = "b AS (SELECT source_id AS here, target_id AS there, source_id, relation, target_id, weight FROM edges {w} UNION ALL SELECT target_id, source_id, source_id, relation, target_id, weight FROM edges {w})"
_SEED = "s AS (SELECT entity_id AS seed FROM entities WHERE type = 'Scheme')"


def _hops(hops: int, where: str = "") -> str:
    one = "SELECT seed, 1 AS hop, source_id, relation, target_id, weight, there FROM s JOIN b ON seed = here"
    two = f" UNION ALL SELECT f.seed, 2, b.source_id, b.relation, b.target_id, b.weight, b.there FROM (SELECT DISTINCT seed, there FROM ({one})) f JOIN b ON f.there = b.here" if hops == 2 else ""
    return f"WITH {_BOTH.format(w=where)}, {_SEED} SELECT seed, source_id, relation, target_id, min(hop)::INT AS hop, max(weight) AS weight FROM ({one}{two}) GROUP BY 1, 2, 3, 4"


_PATHS = """WITH RECURSIVE s AS (SELECT source_id AS u, target_id AS v FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id), m AS (SELECT DISTINCT entity_id FROM press_meets),
    far(node, d) AS (SELECT entity_id, 0 FROM m UNION SELECT v, d + 1 FROM far JOIN s ON node = u WHERE d < 4), w(a, node, path, hops) AS (SELECT entity_id, entity_id, [entity_id], 0 FROM m UNION ALL SELECT a, v, list_append(path, v), hops + 1 FROM w JOIN s ON node = u WHERE hops < 4 AND NOT list_contains(path, v) AND v IN (SELECT node FROM far WHERE d <= 3 - hops)),
    r AS (SELECT * FROM (SELECT a, node AS b, hops, path, row_number() OVER (PARTITION BY a, node ORDER BY hops, path)::INT AS n FROM w WHERE hops > 0 AND a < node AND node IN (SELECT entity_id FROM m)) WHERE n <= 5)"""

_ROOM = f"SELECT chunk_id, n, i, rest, CASE WHEN length(rest) <= 2400 THEN length(rest) WHEN contains(room, chr(10)) AND 2400 - strpos(reverse(room), chr(10)) >= 1200 THEN 2400 - strpos(reverse(room), chr(10)) WHEN contains(room, ' ') AND 2400 - strpos(reverse(room), ' ') >= 1200 THEN 2400 - strpos(reverse(room), ' ') ELSE 2400 END AS cut FROM (SELECT *, substr(rest, 1, 2400) AS room FROM {{}})"
_TRIM = f"regexp_replace(regexp_replace({{}}, '^{SPACE_RE2}+', ''), '{SPACE_RE2}+$', '')"
_LETTERS = r"(length(name) - length(regexp_replace(name, '\p{L}', '', 'g')))"
_ASCII = "(length(name) - length(regexp_replace(name, '[A-Za-z]', '', 'g')))"

SQL = {
    "top_entities": "SELECT entity_id, name, mention_count FROM entities WHERE type = 'Person' AND name IS NOT NULL ORDER BY mention_count DESC, name, entity_id LIMIT 25",
    "extraction_pieces": f"WITH RECURSIVE r(chunk_id, n, i, rest, cut) AS ({_ROOM.replace('{}', '(SELECT DISTINCT chunk_id, length(text) AS n, 0 AS i, text AS rest FROM chunks WHERE text IS NOT NULL)')} UNION ALL {_ROOM.replace('{}', '(SELECT chunk_id, n, i + 1 AS i, substr(rest, cut + 1) AS rest FROM r WHERE length(rest) > cut)')}), p AS (SELECT chunk_id, n, i, {_TRIM.replace('{}', 'substr(rest, 1, cut)')} AS t FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1 AS k FROM p WHERE t <> '') SELECT chunk_id, CASE WHEN n > 2400 THEN chunk_id || '#s' || k ELSE chunk_id END AS piece_id, sha1(trim(regexp_replace(t, '{SPACE_RE2}+', ' ', 'g'))) AS content_hash FROM k",
    "resolve_entities": f"WITH k AS (SELECT type, name, mention_count, {norm('name')} AS key FROM entities), g AS (SELECT type, key, name, sum(mention_count) AS n FROM k WHERE key <> '' GROUP BY 1, 2, 3), b AS (SELECT type, key, arg_min(name, (NOT ({_LETTERS} > 0 AND {_ASCII} > 0.6 * {_LETTERS}), -n, length(name), name)) AS display FROM g GROUP BY 1, 2) SELECT display, count(*) AS n FROM k JOIN b USING (type, key) GROUP BY 1",
    "entity_upsert": f"SELECT k AS entity_id, arg_min(name, entity_id) AS name, arg_min(type, entity_id) AS type, len(list_distinct(flatten(list(coalesce(aliases, []::VARCHAR[])))))::INT AS n_aliases, sum(mention_count)::BIGINT AS mention_count, len(list_distinct(flatten(list(coalesce(press_meet_ids, []::VARCHAR[])))))::INT AS n_meets, min(first_date) AS first_date, max(last_date) AS last_date, bool_or(structural) AS structural FROM (SELECT *, type || ':' || coalesce({norm('name')}, '') AS k FROM entities) GROUP BY 1",
    "relation_collapse": f"WITH {_EV}, ids AS (SELECT entity_id FROM entities UNION SELECT entity_id FROM press_meets), k AS (SELECT * FROM ev WHERE source_id IN (SELECT entity_id FROM ids) AND target_id IN (SELECT entity_id FROM ids)), o AS (SELECT source_id, relation, target_id, x.chunk_id AS c, min(seq) AS s FROM k WHERE x.chunk_id IS NOT NULL GROUP BY 1, 2, 3, 4), n AS (SELECT source_id, relation, target_id, least(count(*), 64)::INT AS n_evidence, arg_min(c, s) AS first_chunk FROM o GROUP BY 1, 2, 3) SELECT source_id, relation, target_id, weight, meets, first_date, last_date, coalesce(n_evidence, 0)::INT AS n_evidence, first_chunk FROM (SELECT source_id, relation, target_id, count(*)::INT AS weight, coalesce(array_to_string(list_sort(list(DISTINCT x.press_meet_id) FILTER (x.press_meet_id <> '')), ','), '') AS meets, min(x.date) AS first_date, max(x.date) AS last_date FROM k GROUP BY 1, 2, 3) LEFT JOIN n USING (source_id, relation, target_id)",
    "evidence_enriched": f"WITH {_EV}, l AS (SELECT chunk_id, min(citation) AS citation, min(page) AS page, min(source_file) AS source_file FROM chunks GROUP BY 1) SELECT source_id, relation, target_id, seq::INT AS seq, x.chunk_id AS chunk_id, l.chunk_id IS NOT NULL AS resolved, coalesce(nullif(x.citation, ''), l.citation, x.citation) AS citation, coalesce(nullif(x.page, 0), l.page, x.page) AS page, coalesce(nullif(x.source_file, ''), l.source_file, x.source_file) AS source_file FROM ev LEFT JOIN l ON x.chunk_id = l.chunk_id",
    "structural_meets": _MEETS,
    "structural_edges": f"WITH {_HEAD}, p AS (SELECT source_file, arg_min(press_meet_id, chunk_id) AS meet, arg_min(publication, chunk_id) AS pub, min(nullif(date, '')) AS date FROM ({_ONCE}) GROUP BY 1), f AS (SELECT 'PressMeet:' || coalesce(nullif(meet, ''), 'unknown') AS source_id, * FROM p) SELECT source_id, relation, target_id, count(*)::INT AS weight FROM (SELECT source_id, 'HELD_ON' AS relation, 'Date:' || min(date) AS target_id FROM f GROUP BY 1 HAVING min(date) IS NOT NULL UNION ALL SELECT source_id, 'CITES_SOURCE', 'Source:' || source_file FROM f UNION ALL SELECT source_id, 'COVERED_BY', 'Publication:' || pub FROM f WHERE pub <> '') GROUP BY 1, 2, 3",
    "precedes_chain": f"SELECT press_meet_id, first_date, next_id FROM (SELECT press_meet_id, first_date, lead(press_meet_id) OVER (ORDER BY first_date, press_meet_id) AS next_id FROM ({_MEETS}) WHERE first_date IS NOT NULL) WHERE next_id IS NOT NULL",
    "ontology_valid": f"SELECT relation, count(*) AS n FROM ({_TYPED}) WHERE (relation, source_type, target_type) IN ({_TRIPLES}) GROUP BY 1",
    "ontology_rejects": f"SELECT relation, source_type, target_type, count(*) AS n FROM ({_TYPED}) WHERE (relation, source_type, target_type) NOT IN ({_TRIPLES}) GROUP BY 1, 2, 3",
    "undirected_projection": "SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, sum(weight)::BIGINT AS weight FROM edges WHERE source_id <> target_id GROUP BY 1, 2",
    "graph_describe": "SELECT 'node' AS what, type AS name, count(*) AS n FROM (SELECT type FROM entities UNION ALL SELECT 'PressMeet' FROM press_meets) GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY 2",
    "entity_resolution_cc": "WITH RECURSIVE b AS (SELECT source_id AS a, target_id AS z FROM edges UNION SELECT target_id, source_id FROM edges), r(node, label) AS (SELECT a, a FROM b UNION SELECT b.z, r.label FROM r JOIN b ON r.node = b.a) SELECT component, count(*) AS n FROM (SELECT node, min(label) AS component FROM r GROUP BY 1) GROUP BY 1",
    "find_entity": "SELECT entity_id, name, tier, mention_count FROM (SELECT *, (CASE WHEN lower(entity_id) = 'power' THEN 0 WHEN lower(name) = 'power' THEN 1 WHEN contains(lower(name), 'power') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'power'))) > 0 THEN 2 END)::INT AS tier FROM entities WHERE type = 'Organization') WHERE tier IS NOT NULL ORDER BY tier, mention_count DESC, entity_id LIMIT 20",
    "neighbors_1hop": _hops(1),
    "neighbors_2hop": _hops(2),
    "neighbors_filtered": _hops(2, "WHERE relation IN ('MENTIONS', 'ACCUSES')"),
    "shortest_paths": f"{_PATHS} SELECT a, b, n, hops, array_to_string(path, ' > ') AS path FROM r",
    "path_edges": f"{_PATHS}, e AS (SELECT source_id, target_id, arg_min(relation, (-weight, relation)) AS relation FROM edges GROUP BY 1, 2), h AS (SELECT a, b, n, i::INT AS hop, path[i] AS u, path[i + 1] AS v FROM (SELECT *, unnest(range(1, len(path))) AS i FROM r)), k AS (SELECT h.*, 0 AS back, e.* FROM h JOIN e ON source_id = u AND target_id = v UNION ALL SELECT h.*, 1, e.* FROM h JOIN e ON source_id = v AND target_id = u) SELECT a, b, n, hop, arg_min(source_id, back) AS source_id, arg_min(relation, back) AS relation, arg_min(target_id, back) AS target_id FROM k GROUP BY 1, 2, 3, 4",
    "timeline": f"WITH {_SEED}, m AS (SELECT seed, unnest(press_meet_ids) AS press_meet_id FROM entities JOIN s ON entity_id = seed UNION SELECT seed, unnest(press_meet_ids) FROM edges JOIN s ON source_id = seed UNION SELECT seed, unnest(press_meet_ids) FROM edges JOIN s ON target_id = seed) SELECT press_meet_id, seed, date, press_meet_title AS title FROM m LEFT JOIN press_meets USING (press_meet_id)",
}
