"""Linking questions to the graph, facts, sources, citations and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.functions.text import SPACE_RE2
from pressloom.operators import answer as K
from pressloom.operators import extraction as X
from pressloom.operators import facts as J
from pressloom.operators import graph as G
from pressloom.operators.filters import Filters
from pressloom.plans import retrieve as P
from pressloom.queries.documents import norm
from pressloom.queries.graph import _edges, _nodes
from pressloom.queries.retrieval import _hybrid, chunk_vectors, chunks, found, index, index_stats, question_vectors
from pressloom.session import cut_lineage
from pressloom.sources.tables import table


def named_questions(spark, d) -> DataFrame:
    """One question for each entity; the items' own questions name nobody in the graph."""
    e = table(spark, d, "entities", "entity_id", "name").where("name <> ''").distinct()
    return e.select(F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint").alias("qid"), F.concat(F.lit("What did "), "name", F.lit(" say about power and water dues?")).alias("q"))


def link_entities(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    return J.link_entities(named_questions(spark, d), n, J.name_index(n)).select("qid", "entity_id", "matched", "n")


def scoped_facts(spark, d) -> DataFrame:
    s = J.scope(_edges(spark, d), Filters(language="en"))
    return s.select("source_id", "relation", "target_id", "n_evidence", "weight", F.array_join("press_meet_ids", ",").alias("meets"), "first_date", "last_date")


def unscoped_facts(spark, d) -> DataFrame:
    return J.scope(_edges(spark, d)).select("source_id", "relation", "target_id", "n_evidence", "weight", "first_date", "last_date")


def _gathered(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    q = named_questions(spark, d)
    return J.gather(q, J.link_entities(q, n, J.name_index(n)), _edges(spark, d), n)


def gathered(spark, d) -> DataFrame:
    return _gathered(spark, d).select("qid", "n", "source_id", "relation", "target_id", F.round("relevance", 4).alias("relevance"))


def _found(spark, d) -> DataFrame:
    return found(spark, d, named_questions(spark, d))


def confidence(spark, d) -> DataFrame:
    n, q = _nodes(spark, d), named_questions(spark, d)
    return K.confidence(q, _found(spark, d), J.link_entities(q, n, J.name_index(n)))


def prompt_sources(spark, d) -> DataFrame:
    f = cut_lineage(_gathered(spark, d).select("qid", "n", "source_id", "relation", "target_id", "source", "target", "structural", "evidence"))
    p = P.with_texts(cut_lineage(_found(spark, d).select("qid", "rank", "chunk_id")), chunks(spark, d), named_questions(spark, d))
    return K.sources(p, f, K.promoted(f, p, chunks(spark, d))).select("qid", "n", "kind", "promoted", "citation", F.length("body").alias("size"))


def _context(spark, d) -> P.Context:
    q = named_questions(spark, d)
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    c = cut_lineage(G.number_communities(G.communities(G.undirected(edges)), nodes))
    return P.retrieve(chunks(spark, d), q, nodes, edges, table(spark, d, "press_meets"), vectors=chunk_vectors(spark, d), question_vectors=question_vectors(q), community=c, index=index(spark, d), stats=index_stats(spark, d))


def diagnostics(spark, d) -> DataFrame:
    return _context(spark, d).diagnostics


def question_timelines(spark, d) -> DataFrame:
    q, n = named_questions(spark, d), _nodes(spark, d)
    return P.timelines(q, J.link_entities(q, n, J.name_index(n)), n, _edges(spark, d), table(spark, d, "press_meets"))


def question_communities(spark, d) -> DataFrame:
    q, nodes = named_questions(spark, d), _nodes(spark, d)
    c = G.number_communities(G.communities(G.undirected(_edges(spark, d))), nodes)
    return P.communities_of(J.link_entities(q, nodes, J.name_index(nodes)), c, nodes).select("qid", "n", "community_id", "size", F.array_join("members", "; ").alias("members"))


def answered(spark, d) -> DataFrame:
    """Answers without a model: sentences of the sources, by a judge that always agrees."""
    c = _context(spark, d)
    s = K.sources(c.passages, c.facts, K.promoted(c.facts, c.passages, chunks(spark, d)))
    made = K.answers(K.prompts(named_questions(spark, d), s, c.timeline, c.communities), s, lambda: lambda prompt, own: X.extractive(prompt.split("\n", 1)[0], own), lambda: lambda what, text: True)
    return made.select("qid", F.length("answer").alias("size"), F.array_join("cited", ",").alias("cited"), "uncited", "refused")


def promoted(spark, d) -> DataFrame:
    return K.promoted(_gathered(spark, d), _found(spark, d), chunks(spark, d)).select("qid", "chunk_id", "citation", F.length("text").alias("size"))


def cited_passages(spark, d) -> DataFrame:
    """Passages as answers that cite two sources, one of them invented."""
    a = table(spark, d, "eval_items", "item_id", "passage").select(F.col("item_id").alias("qid"), F.concat("passage", F.lit(" [1] [9]")).alias("text"), F.array(F.lit(1), F.lit(2)).alias("sources"))
    v = K.verify_citations(a)
    return v.select("qid", F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), "uncited", K.verdict(F.lit(True), F.lit(True)).alias("verdict"))


def cited_claims(spark, d) -> DataFrame:
    a = table(spark, d, "eval_items", "item_id", "passage").select(F.col("item_id").alias("qid"), F.regexp_replace("passage", r"\.(\s|$)", " [1].$1").alias("clean"))
    return K.claims(a).select("qid", "n", F.length("claim").alias("size"))


def passage_neighbours(spark, d) -> DataFrame:
    c = table(spark, d, "chunks", "chunk_id", "source_file", "source_type")
    return K.neighbours(c, c.where("source_type = 'table'"))


QUERIES = {
    "link_entities": link_entities, "scope_facts": scoped_facts, "all_facts": unscoped_facts, "fact_rank": gathered, "retrieval_confidence": confidence, "prompt_sources": prompt_sources, "retrieve_diagnostics": diagnostics, "question_timelines": question_timelines, "question_communities": question_communities, "answers_offline": answered, "promoted_passages": promoted,
    "citation_verify": cited_passages, "citation_claims": cited_claims, "passage_neighbours": passage_neighbours,
}


def _scope(condition: str, weight: str) -> str:
    return f"SELECT source_id, relation, target_id, len(f)::INT AS n_evidence, {weight} AS weight, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(f[1:2], lambda e: e.press_meet_id), lambda m: m <> ''))), ','), '') AS meets, list_min(ds) AS first_date, list_max(ds) AS last_date FROM (SELECT *, list_filter(list_transform(f[1:2], lambda e: e.date), lambda x: x <> '') AS ds FROM (SELECT *, list_filter(coalesce(evidence, []), lambda e: coalesce(e.chunk_id <> '' AND e.source_file <> '' AND {condition}, false)) AS f FROM edges)) WHERE len(f) > 0"


#: Sentences of a text: short forms lose their periods before the text is cut at line breaks.
_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({}, '(?i)(^|[^\p{L}\p{M}\p{N}_])(Rs|Mr|Mrs|Ms|Dr|No|Nos|St|vs|e\.g|i\.e|రూ|శ్రీ)\.', '\1\2' || chr(1), 'g'), '(?i)(^|[^\p{L}\p{M}\p{N}_])(Rs|Mr|Mrs|Ms|Dr|No|Nos|St|vs|e\.g|i\.e|రూ|శ్రీ)\.', '\1\2' || chr(1), 'g'), '([.!?।])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '' AND NOT starts_with(s, '#'))"

_STOPS = ", ".join(f"'{w}'" for w in S.TOPIC_STOPWORDS)
_KINDS = ", ".join(f"'{k}'" for k in J.STRUCTURAL_TYPES)
_ASKED = "(SELECT DISTINCT regexp_extract(entity_id, '(\\d+)$', 1)::BIGINT AS qid, 'What did ' || name || ' say about power and water dues?' AS q FROM entities WHERE name <> '')"
#: Common tables up to ``lk``: the entities every question names, by a greedy cover walked span by span.
_LINKED = f"""no AS (SELECT entity_id, name, type, aliases, mention_count, press_meet_ids FROM entities UNION ALL SELECT entity_id, press_meet_title, 'PressMeet', []::VARCHAR[], 0, [press_meet_id] FROM press_meets),
    ix AS (SELECT DISTINCT {norm('s')} AS surface, entity_id FROM (SELECT entity_id, unnest(list_concat([name], coalesce(aliases, []::VARCHAR[]))) AS s FROM no)), us AS (SELECT surface, entity_id, type, mention_count FROM ix JOIN no USING (entity_id) WHERE surface <> '' AND (type NOT IN ({_KINDS}) OR length(surface) >= {J.MIN_STRUCTURAL_CHARS})),
    wd AS (SELECT qid, list_filter(string_split({norm('q')}, ' '), lambda x: x <> '') AS ws FROM {_ASKED}), sp AS (SELECT DISTINCT qid, i - 1 AS s, i - 1 + k AS e, array_to_string(ws[i:i + k - 1], ' ') AS surface FROM (SELECT qid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT qid, ws, unnest(range(1, 6)) AS k FROM wd))),
    hs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s - e, s, e, surface) AS rn FROM sp WHERE surface NOT IN ({_STOPS}) AND surface IN (SELECT surface FROM us)),
    gr(qid, rn, kept) AS (SELECT DISTINCT qid, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT, surface VARCHAR)[] FROM hs UNION ALL SELECT gr.qid, hs.rn, CASE WHEN len(list_filter(kept, lambda y: hs.s < y.e AND y.s < hs.e)) = 0 THEN list_append(kept, {{'s': hs.s, 'e': hs.e, 'surface': hs.surface}}) ELSE kept END FROM gr JOIN hs ON hs.qid = gr.qid AND hs.rn = gr.rn + 1),
    la AS (SELECT qid, unnest(kept).surface AS surface FROM (SELECT qid, arg_max(kept, rn) AS kept FROM gr GROUP BY 1)), lk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(matched) DESC, mention_count DESC, entity_id)::INT AS n FROM (SELECT qid, entity_id, arg_max(surface, (length(surface), surface)) AS matched, any_value(mention_count) AS mention_count FROM la JOIN us USING (surface) GROUP BY 1, 2)) WHERE n <= {J.LINK_LIMIT})"""
_TIMES = """hd AS (SELECT qid, entity_id AS seed, press_meet_ids FROM lk JOIN no USING (entity_id) WHERE n = 1 AND len(press_meet_ids) > 1), sd AS (SELECT DISTINCT seed FROM hd),
    mt AS (SELECT seed, unnest(press_meet_ids) AS press_meet_id FROM (SELECT DISTINCT seed, press_meet_ids FROM hd) UNION SELECT seed, unnest(press_meet_ids) FROM edges JOIN sd ON source_id = seed UNION SELECT seed, unnest(press_meet_ids) FROM edges JOIN sd ON target_id = seed)"""

_topic = lambda c: f"list_distinct(list_filter(string_split({norm(c)}, ' '), lambda x: x <> '' AND x NOT IN ({_STOPS})))"
_GENERIC = ", ".join(f"'{w}'" for w in K.GENERIC)
_HITS = _hybrid(asked=_ASKED)

_PRIORITY = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in J.PRIORITY.items()) + " ELSE 5 END"
#: Common tables up to ``fc``: the facts of every question in their order.
_FACTS = f"""fs AS (SELECT *, f[1:2] AS ev2 FROM (SELECT source_id, relation, target_id, structural, weight, list_filter(coalesce(evidence, []), lambda e: coalesce(e.chunk_id <> '' AND e.source_file <> '', false)) AS f FROM edges) WHERE len(f) > 0),
    th AS (SELECT DISTINCT qid, source_id, relation, target_id FROM (SELECT qid, fs.* FROM lk JOIN fs ON source_id = entity_id UNION ALL SELECT qid, fs.* FROM lk JOIN fs ON target_id = entity_id)),
    tm AS (SELECT a.qid, list_filter({_topic('q')}, lambda x: NOT list_contains(coalesce(m, []::VARCHAR[]), x)) AS terms FROM {_ASKED} a LEFT JOIN (SELECT qid, flatten(list(string_split(matched, ' '))) AS m FROM lk GROUP BY 1) b USING (qid)),
    bd AS (SELECT source_id, relation, target_id, {_topic('body')} AS words FROM (SELECT fs.source_id, relation, fs.target_id, concat_ws(' ', coalesce(s.name, source_id), relation, coalesce(t.name, target_id), array_to_string(list_transform(ev2, lambda e: coalesce(e.quote, '')), ' ')) AS body FROM fs LEFT JOIN no s ON s.entity_id = source_id LEFT JOIN no t ON t.entity_id = target_id)),
    rl AS (SELECT qid, source_id, relation, target_id, structural, weight, ev2, terms, CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_intersect(terms, words)) / len(terms) + CASE WHEN structural THEN 0.0 ELSE 0.25 END END AS relevance FROM th JOIN fs USING (source_id, relation, target_id) JOIN bd USING (source_id, relation, target_id) JOIN tm USING (qid)),
    oc AS (SELECT *, relevance > 0.3 AND len(terms) > 0 AS hit, count(*) FILTER (relevance > 0.3 AND len(terms) > 0) OVER (PARTITION BY qid) AS n_on FROM rl),
    fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, structural, {_PRIORITY}, weight DESC, source_id, relation, target_id)::INT AS n FROM oc WHERE len(terms) = 0 OR n_on < 3 OR hit) WHERE n <= CASE WHEN len(terms) > 0 AND n_on < 3 THEN 6 ELSE 20 END)"""
_SPACED = lambda c: f"trim(regexp_replace({c}, '{SPACE_RE2}+', ' ', 'g'))"
#: Common tables up to ``pm``: chunks that stand behind the facts and were not retrieved.
_PROMOTED = f"""ex AS (SELECT qid, n, e.chunk_id AS chunk_id, e.quote AS quote FROM (SELECT qid, n, unnest(ev2) AS e FROM fc WHERE NOT structural AND relation NOT IN ('MENTIONS', 'MEMBER_OF'))),
    fr AS (SELECT qid, chunk_id, min(n) AS n, arg_min(quote, (n, quote)) AS quote FROM ex WHERE quote <> '' AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM hits) GROUP BY 1, 2),
    pm AS (SELECT qid, r, chunk_id, citation, CASE WHEN length(s) <= 1100 THEN s ELSE substr(s, greatest(strpos(s, q) - 366, 1), 1100) END AS body FROM (SELECT qid, r, chunk_id, citation, {_SPACED('text')} AS s, {_SPACED('quote')} AS q FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n, chunk_id)::INT AS r FROM fr) JOIN (SELECT DISTINCT chunk_id, text, citation FROM chunks) USING (chunk_id) WHERE r <= 4))"""

def _clip(c: str, n: int) -> str:
    return f"CASE WHEN length({_SPACED(c)}) <= {n} THEN {_SPACED(c)} WHEN contains(substr({_SPACED(c)}, 1, {n}), ' ') THEN regexp_extract(substr({_SPACED(c)}, 1, {n}), '(?s)^(.*) ', 1) || ' …' ELSE substr({_SPACED(c)}, 1, {n}) || ' …' END"


#: Common tables up to ``sl``: what goes into the prompts.
_SOURCES = f"""al AS (SELECT qid, 'passage' AS kind, false AS promoted, 0 AS g, rank AS p, {_clip('text', 1100)} AS body, citation, date FROM hits UNION ALL SELECT qid, 'passage', true, 1, r, body, citation, NULL FROM pm
    UNION ALL SELECT qid, 'fact', false, 2, n, src || ' --' || relation || '--> ' || tgt || CASE WHEN quote <> '' THEN chr(10) || 'Supporting quote: "' || quote || '"' ELSE '' END, cit, dat FROM (SELECT qid, n, relation, coalesce(s.name, source_id) AS src, coalesce(t.name, target_id) AS tgt, {_clip("coalesce(ev2[1].quote, '')", 400)} AS quote, ev2[1].citation AS cit, ev2[1].date AS dat FROM fc LEFT JOIN no s ON s.entity_id = source_id LEFT JOIN no t ON t.entity_id = target_id)),
    nm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY g, p) AS n FROM al), sz AS (SELECT *, length('[' || n || '] (' || kind || ') ' || coalesce(citation, '') || CASE WHEN coalesce(date, '') <> '' THEN '  date=' || date ELSE '' END || body) + 2 AS size FROM nm),
    rn AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY promoted DESC, n) AS pos, sum(size) OVER (PARTITION BY qid, kind ORDER BY promoted DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM sz),
    ff AS (SELECT * FROM rn WHERE kind = 'fact' AND pos <= 8 AND (pos = 1 OR total <= 4000)), uu AS (SELECT qid, sum(size) AS used FROM ff GROUP BY 1), sl AS (SELECT rn.* FROM rn LEFT JOIN uu USING (qid) WHERE kind = 'passage' AND pos <= 12 AND (pos = 1 OR total <= greatest(14000 - coalesce(used, 0), 0)) UNION ALL SELECT * FROM ff)"""

SQL = {
    "prompt_sources": f"WITH RECURSIVE {_LINKED}, {_FACTS}, {_HITS}, {_PROMOTED}, {_SOURCES} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY kind DESC, pos)::INT AS n, kind, promoted, citation, length(body)::INT AS size FROM sl",
    "fact_rank": f"WITH RECURSIVE {_LINKED}, {_FACTS} SELECT qid, n, source_id, relation, target_id, round(relevance, 4) AS relevance FROM fc",
    "promoted_passages": f"WITH RECURSIVE {_LINKED}, {_FACTS}, {_HITS}, {_PROMOTED} SELECT qid, chunk_id, citation, length(body)::INT AS size FROM pm",
    "retrieval_confidence": f"WITH RECURSIVE {_LINKED}, {_HITS}, tt AS (SELECT qid, list_filter({_topic('q')}, lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\\p{{Nd}}+')) AS terms FROM {_ASKED}), gg AS (SELECT qid, max(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {_topic("concat_ws(' ', coalesce(text, ''), coalesce(citation, ''))")})) / len(terms) ELSE 0 END) AS cover, least(1.0, count(*) FILTER (legs = 2) / 2) AS agree FROM hits JOIN tt USING (qid) WHERE rank <= 5 GROUP BY 1), ee AS (SELECT DISTINCT qid FROM lk WHERE matched NOT IN ({_GENERIC}) AND length(matched) >= 3), rr AS (SELECT tt.qid, coalesce(cover, 0.0) AS cover, coalesce(agree, 0.0) AS agree, ee.qid IS NOT NULL AS ent FROM tt LEFT JOIN gg USING (qid) LEFT JOIN ee ON ee.qid = tt.qid) SELECT qid, round(CASE WHEN ent THEN 0.5 * cover + 0.25 * agree + 0.25 ELSE least(0.5 * cover + 0.25 * agree, 0.45) END, 4) AS score, round(cover, 4) AS term_coverage, agree AS retrieval_agreement, ent AS has_entity FROM rr",
    "link_entities": f"WITH RECURSIVE {_LINKED} SELECT qid, entity_id, matched, n FROM lk",
    "question_timelines": f"WITH RECURSIVE {_LINKED}, {_TIMES} SELECT qid, n, press_meet_id, date, title FROM (SELECT qid, press_meet_id, date, press_meet_title AS title, row_number() OVER (PARTITION BY qid ORDER BY date ASC NULLS LAST, press_meet_id)::INT AS n FROM hd JOIN mt USING (seed) LEFT JOIN press_meets USING (press_meet_id)) WHERE n <= 15",
    "citation_verify": "SELECT item_id AS qid, '1' AS cited, '9' AS invalid, len(list_filter("
    + _SENTENCES.replace("{}", r"CASE WHEN regexp_matches(passage, '[.!?।]\s*$') THEN regexp_replace(passage, '([.!?।])\s*$', ' [1]\1') ELSE passage || ' [1]' END")
    + r", lambda s: length(regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g')) >= 4 AND NOT regexp_matches(s, '\[\d{1,3}(\s*,\s*\d{1,3})*\]')))::INT AS uncited, 'invalid_citations' AS verdict FROM eval_items",
    "citation_claims": "SELECT qid, (i)::INT AS n, length(c[i])::INT AS size FROM (SELECT qid, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT item_id AS qid, list_filter("
    + _SENTENCES.replace("{}", r"regexp_replace(passage, '\.(\s|$)', ' [1].\1', 'g')")
    + r", lambda s: contains(s, '[1]')) AS c FROM eval_items))",
    "scope_facts": _scope("e.language = 'en'", "len(f)::INT"),
    "all_facts": f"SELECT source_id, relation, target_id, n_evidence, weight, first_date, last_date FROM ({_scope('true', 'weight')})",
    "passage_neighbours": "WITH f AS (SELECT DISTINCT chunk_id, source_file, source_type FROM chunks), p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_id) AS i FROM (SELECT DISTINCT chunk_id, source_file FROM f)), h AS (SELECT p.* FROM p WHERE chunk_id IN (SELECT chunk_id FROM f WHERE source_type = 'table')) SELECT h.chunk_id AS hit, p.chunk_id AS chunk_id, (p.i - h.i)::INT AS \"offset\" FROM h JOIN p ON h.source_file = p.source_file AND abs(p.i - h.i) <= 2",
}
