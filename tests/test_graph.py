import random

import pytest
from pyspark.sql import functions as F

from pressloom.operators import answer as K
from pressloom.operators import chunking as D
from pressloom.operators import facts as J
from pressloom.operators import graph as G
from pressloom.operators.components import connected_components
from pressloom.functions.scalars import normalise_name
from pressloom.operators.filters import Filters
from pressloom.queries import documents as documents_q
from pressloom.queries import graph as graph_q

EV = "struct<chunk_id:string,quote:string,source_file:string,citation:string,press_meet_id:string,date:string,source_type:string,publication:string,language:string,page:int,slide:int,video_start:double,video_end:double>"
EDGE = f"source_id string, relation string, target_id string, weight int, structural boolean, press_meet_ids array<string>, first_date string, last_date string, evidence array<{EV}>"


def ev(c, meet="1", date="2024-01-01", lang="en", file="f", quote="q", page=None):
    return (c, quote, file, f"cite {c}", meet, date, "source_doc", None, lang, page, None, None, None)


def edges(spark, *rows):
    full = [(a, r, b, w, False, [], None, None, e) for a, r, b, w, e in rows]
    return spark.createDataFrame(full, EDGE)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [("hub", f"h{i}") for i in range(30)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("solo", "solo"), (None, "x")]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_merge_entities_keeps_first_name(spark):
    rows = [("P:a", "A", "Person", ["x"], 2, ["1"], "2024-02-01", None, False, 0), ("P:a", "a", "Person", None, 3, ["2", "1"], "2024-01-01", "2024-05-01", True, 1)]
    df = spark.createDataFrame(rows, "entity_id string, name string, type string, aliases array<string>, mention_count int, press_meet_ids array<string>, first_date string, last_date string, structural boolean, seq int")
    r = G.merge_entities(df).first()
    assert (r.name, r.aliases, r.mention_count, r.press_meet_ids, r.first_date, r.last_date, r.structural) == ("A", ["x"], 5, ["1", "2"], "2024-01-01", "2024-05-01", True)


def test_names_of_every_script_are_merged(spark, tmp_path):
    rows = [("e1", "Sri Rama Rao", "Person", ["RR"], 2, ["1"], "2024-01-02", "2024-01-05", False), ("e2", "rama  rao.", "Person", ["Rao"], 3, ["2"], "2024-01-01", "2024-01-03", True)]
    rows += [("e3", "శ్రీ రామారావు", "Person", ["రామా"], 1, ["1"], None, None, False), ("e4", "రామారావు,", "Person", None, 4, ["3"], "2024-02-01", "2024-02-01", False), ("e5", "श्री राम", "Person", [], 1, None, None, None, False), ("e6", "ＳＥＣＩ", "Organization", [], 1, [], None, None, False), ("e7", "seci", "Organization", [], 1, [], None, None, False), ("e8", "రామారావు", "Place", [], 1, [], None, None, False)]
    spark.createDataFrame(rows, "entity_id string, name string, type string, aliases array<string>, mention_count int, press_meet_ids array<string>, first_date string, last_date string, structural boolean").write.parquet(f"{tmp_path}/entities.parquet")
    want: dict = {}
    for e, name, kind, aliases, n, meets, a, z, structural in rows:
        r = want.setdefault(f"{kind}:{normalise_name(name)}", [name, kind, set(), 0, set(), [], [], False])
        r[2].update(aliases or []), r[4].update(meets or []), r[5].append(a), r[6].append(z)
        r[3], r[7] = r[3] + n, r[7] or structural
    got = {r.entity_id: tuple(r)[1:] for r in graph_q.merged_entities(spark, str(tmp_path)).collect()}
    least = lambda f, x: f([d for d in x if d], default=None)
    assert got == {k: (r[0], r[1], len(r[2]), r[3], len(r[4]), least(min, r[5]), least(max, r[6]), r[7]) for k, r in want.items()}
    assert len([k for k in got if not k.isascii()]) == 3 and len(got) == 5
    assert {r.entity_id: r.name for r in documents_q.normalised_names(spark, str(tmp_path)).collect()} == {r[0]: normalise_name(r[1]) for r in rows}


def test_ngrams_of_questions_in_every_script(spark, tmp_path):
    rows = [("q1", "Who met SECI?"), ("q2", "రామారావు ఎవరిని కలిశారు ?"), ("q3", "बिजली किसने खरीदी")]
    spark.createDataFrame(rows, "item_id string, q string").write.parquet(f"{tmp_path}/eval_items.parquet")
    want = {}
    for i, q in rows:
        w = normalise_name(q).split()
        grams = [" ".join(w[j : j + k]) for k in range(1, 6) for j in range(len(w) - k + 1)]
        want[i] = (len(grams), max(map(len, grams)))
    assert {r.item_id: (r.n, r.longest) for r in documents_q.question_ngrams(spark, str(tmp_path)).collect()} == want


def test_collapse_caps_distinct_chunks_and_drops_loose_ends(spark):
    e = edges(spark, ("a", "R", "b", 1, [ev("c1"), ev("c1"), ev("c2"), ev("c3", meet="2")]), ("a", "R", "zz", 1, [ev("c1")]))
    nodes = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    (r,) = G.collapse_relations(G.assertions_of(e), nodes, cap=2).collect()
    assert (r.weight, r.press_meet_ids, [x.chunk_id for x in r.evidence]) == (4, ["1", "2"], ["c1", "c2"])


def test_enrich_fills_only_what_is_empty(spark):
    e = edges(spark, ("a", "R", "b", 1, [ev("c1"), ev("c9", page=4)]))
    loc = spark.createDataFrame([("c1", "other", "label", "7", "d", "pdf", "pub", "te", 7, None, None, None)], "chunk_id string, source_file string, citation string, press_meet_id string, date string, source_type string, publication string, language string, page int, slide int, video_start double, video_end double")
    got = {r.chunk_id: r for r in G.enrich_evidence(e, loc).collect()}
    assert (got["c1"].page, got["c1"].resolved, got["c1"].citation, got["c1"].publication) == (7, True, "cite c1", "pub")
    assert (got["c9"].page, got["c9"].resolved) == (4, False)


def test_neighbours_and_paths(spark):
    e = edges(spark, ("a", "R", "b", 3, []), ("b", "S", "c", 1, []), ("c", "R", "d", 1, []), ("a", "R", "d", 1, []), ("x", "R", "y", 1, []))
    seeds = spark.createDataFrame([("a",)], "seed string")
    two = {(r.source_id, r.target_id): r.hop for r in G.neighbours(e, seeds, 2).collect()}
    assert two == {("a", "b"): 1, ("a", "d"): 1, ("b", "c"): 2, ("c", "d"): 2}
    assert {(r.source_id, r.target_id) for r in G.neighbours(e, seeds, 2, ["R"]).collect()} == {("a", "b"), ("a", "d"), ("c", "d")}
    pairs = spark.createDataFrame([("a", "c"), ("a", "y")], "a string, b string")
    paths = [(r.hops, r.path) for r in G.shortest_paths(e, pairs, 4, 5).orderBy("n").collect()]
    assert paths == [(2, ["a", "b", "c"]), (2, ["a", "d", "c"])]


def test_paths_of_all_meets(spark, tmp_path):
    r = random.Random(7)
    meets = [f"PressMeet:{i}" for i in range(8)]
    links = {(r.choice(meets[:6]), f"Person:{r.randrange(9)}") for _ in range(26)} | {("PressMeet:5", "Place:1"), ("Place:1", "Place:2"), ("Place:2", "Place:3"), ("PressMeet:6", "Place:3"), ("PressMeet:0", "PressMeet:1")}
    edges(spark, *[(a, "R", b, 1, []) for a, b in sorted(links)]).write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(m,) for m in meets], "entity_id string").write.parquet(f"{tmp_path}/press_meets.parquet")
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def walks(path, b):
        if path[-1] == b:
            yield path
        elif len(path) <= 4:
            for x in near.get(path[-1], set()) - set(path):
                yield from walks([*path, x], b)

    want = {(a, b): sorted(walks([a], b), key=lambda p: (len(p), p))[:5] for a in meets for b in meets if a < b}
    got: dict = {}
    for x in graph_q._paths(spark, str(tmp_path)).orderBy("a", "b", "n").collect():
        assert x.hops == len(x.path) - 1
        got.setdefault((x.a, x.b), []).append(x.path)
    assert got == {k: v for k, v in want.items() if v}
    assert len(got["PressMeet:5", "PressMeet:6"][0]) == 5 and ("PressMeet:0", "PressMeet:7") not in got and max(map(len, got.values())) == 5


def test_production_caps(spark, tmp_path):
    edges(spark, ("Person:a", "R", "Person:b", 1, [ev(f"c{i:02}") for i in range(70)]), ("Person:b", "R", "Person:a", 1, [ev(f"c{i}") for i in range(4)])).write.parquet(f"{tmp_path}/edges.parquet")
    node = [(n, n, "Person", [], 1, []) for n in ("Person:a", "Person:b")]
    spark.createDataFrame(node, "entity_id string, name string, type string, aliases array<string>, mention_count int, press_meet_ids array<string>").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame([], "entity_id string, press_meet_title string, press_meet_id string").write.parquet(f"{tmp_path}/press_meets.parquet")
    assert {r.source_id: r.n_evidence for r in graph_q.collapsed_relations(spark, str(tmp_path)).collect()} == {"Person:a": 64, "Person:b": 4}
    rows = [(f"c{i:02}", "a long enough text " * 20 + str(i), str(i), "big.pdf", "source_doc") for i in range(65)]
    spark.createDataFrame(rows, "chunk_id string, text string, content_hash string, source_file string, source_type string").write.parquet(f"{tmp_path}/chunks.parquet")
    kept = documents_q.select_capped(spark, str(tmp_path)).where("skip is null").count()
    assert kept == 60


def test_communities_find_two_cliques(spark):
    rows = [(f"{s}{i}", f"{s}{j}", 5) for s in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1)]
    links = spark.createDataFrame(rows, "u string, v string, weight int")
    label = G.communities(links)
    got = {r.node: r.community for r in label.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]
    assert G.modularity(links, label).first()[0] > 0.4
    nodes = spark.createDataFrame([(n,) for n in [*got, "z"]], "entity_id string")
    named = {r.node: r.community_id for r in G.number_communities(label, nodes).collect()}
    assert sorted(set(named.values())) == ["c0000", "c0001", "c0002"] and named["z"] == "c0002"


def test_ontology(spark):
    e = edges(spark, ("Person:a", "ACCUSES", "Person:b", 1, []), ("Person:a", "ACCUSES", "Place:c", 1, []))
    t = G.legal_triples({"ACCUSES": (["Person"], ["Person"])}, spark)
    assert [r.target_id for r in G.valid_edges(e, t).collect()] == ["Person:b"]
    assert [r.target_id for r in G.valid_edges(e, t, invert=True).collect()] == ["Place:c"]


NODE = "entity_id string, name string, type string, aliases array<string>, mention_count int, press_meet_ids array<string>"


def test_link_entities_prefers_long_spans(spark):
    n = spark.createDataFrame([("P:1", "Rao", "Person", [], 9, []), ("P:2", "Smt. Ramya Rao", "Person", ["రమ్య"], 5, []), ("M:1", "Meet", "PressMeet", [], 1, []), ("M:2", "Long Meet", "PressMeet", [], 1, [])], NODE)
    q = spark.createDataFrame([(1, "What did Ramya Rao say?"), (2, "Rao and రమ్య at the Long Meet"), (3, "meet who"), (4, "")], "qid long, q string")
    got: dict = {}
    for r in J.link_entities(q, n, J.name_index(n)).orderBy("qid", "n").collect():
        got.setdefault(r.qid, []).append((r.entity_id, r.matched))
    assert got == {1: [("P:2", "ramya rao")], 2: [("M:2", "long meet"), ("P:2", "రమ్య"), ("P:1", "rao")]}


def test_scope_filters_evidence(spark):
    e = edges(spark, ("a", "R", "b", 9, [ev(f"c{i}", meet=str(i), date=f"2024-0{i}-01") for i in range(1, 5)] + [ev("c10", meet="10")]), ("a", "R", "c", 5, [ev("x", file="")]), ("a", "R", "d", 5, None))
    (r,) = J.scope(e, Filters(press_meet_id="10")).collect()
    assert (r.weight, r.n_evidence, r.press_meet_ids, [x.chunk_id for x in r.evidence]) == (1, 1, ["10"], ["c10"])
    (r,) = J.scope(e).collect()
    assert (r.weight, r.press_meet_ids, r.first_date, r.last_date) == (9, ["1", "2"], "2024-01-01", "2024-02-01")


def test_gather_keeps_facts_on_topic(spark):
    n = spark.createDataFrame([("P:a", "Asha", "Person", [], 1, []), *[(f"O:{i}", f"Body {i}", "Organization", [], 1, []) for i in range(9)]], NODE)
    e = edges(spark, *[("P:a", "ACCUSES", f"O:{i}", 1, [ev("c", quote="water dues" if i < 4 else "bus")]) for i in range(9)])
    q = spark.createDataFrame([(1, "What did Asha say about water dues?"), (2, "Asha bus stops")], "qid long, q string")
    got: dict = {}
    for r in J.gather(q, J.link_entities(q, n, J.name_index(n)), e, n).collect():
        got.setdefault(r.qid, set()).add(r.target_id)
    assert got[1] == {f"O:{i}" for i in range(4)}
    assert got[2] == {f"O:{i}" for i in range(4, 9)}


@pytest.mark.parametrize(
    "text, clean, cited, invalid, uncited",
    [("A fact [1]. Another [2].", "A fact [1]. Another [2].", [1, 2], [], 0), ("Wrong [9].", "Wrong .", [], [9], 1), ("Both [1, 7].", "Both [1].", [1], [7], 0), ("It cost Rs. 2 crore. [1]", "It cost Rs. 2 crore [1].", [1], [], 0), ("No source here. Yes [1].", "No source here. Yes [1].", [1], [], 1), (None, "", [], [], 0)],
)
def test_verify_citations(spark, text, clean, cited, invalid, uncited):
    a = spark.createDataFrame([(1, text, [1, 2])], "qid long, text string, sources array<int>")
    r = K.verify_citations(a).first()
    assert (r.clean, list(r.cited), list(r.invalid), r.uncited) == (clean, cited, invalid, uncited)


def test_verdict_ladder(spark):
    a = spark.createDataFrame([(1, "Good [1].", [1]), (2, "Bad [7].", [1]), (3, "Plain words here.", [1]), (4, "Fine [1].", None)], "qid int, text string, sources array<int>")
    got = {r.qid: r.v for r in K.verify_citations(a).select("qid", K.verdict(F.lit(True), F.col("qid") < 3).alias("v")).collect()}
    assert got == {1: None, 2: "invalid_citations", 3: "uncited_sentences", 4: "invalid_citations"}


def test_neighbours_stay_in_their_file(spark):
    c = spark.createDataFrame([(f"{f}{i}", f) for f in "ab" for i in range(5)], "chunk_id string, source_file string")
    got = {(r.chunk_id, r.offset) for r in K.neighbours(c, c.where("chunk_id = 'a1'")).collect()}
    assert got == {("a0", -1), ("a1", 0), ("a2", 1), ("a3", 2)}


def test_split_chars_overlaps_and_covers():
    text = "".join(f"Sentence number {i} is here. " + ("\n\n" if i % 20 == 0 else "") for i in range(900))
    got = D.split_chars(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and len(got) > 3
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == b - 600 and d > b and b - a <= 5000
    assert D.split_chars("x" * 12000)[0] == (0, 5000)
    assert D.split_chars("short") == [(0, 5)]


def test_passages_of_odd_texts(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "  ", 2), ("c", " hello ", 3), ("c", " hello ", 3)], "id string, t string, text int")
    assert [(r.item_id, r.idx, r.text) for r in D.passages(df, "id", "t").collect()] == [("c", 0, "hello")] * 2


def brute_select(rows, cap):
    seen, kept, out = set(), {}, {}
    for c, f, h in sorted(rows, key=lambda r: (r[1], r[0])):
        if kept.get(f, 0) >= cap > 0:
            out[c] = "over_file_cap"
        elif (h or c) in seen:
            out[c] = "duplicate"
        else:
            seen.add(h or c)
            kept[f] = kept.get(f, 0) + 1
            out[c] = None
    return out


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_select_chunks_is_the_sequential_rule(spark, cap):
    rng = random.Random(cap)
    rows = [(f"c{i:03}", f"f{rng.randrange(12):02}", rng.choice(["", None, *(f"h{k}" for k in range(25))])) for i in range(150)]
    df = spark.createDataFrame([(c, "x" * 200, h, f, "source_doc") for c, f, h in rows], "chunk_id string, text string, content_hash string, source_file string, source_type string")
    assert {r.chunk_id: r.skip for r in D.select_chunks(df, cap=cap).collect()} == brute_select(rows, cap)


def test_merge_spans_is_a_fold(spark):
    seg = "segment_id string, source_file string, text_original string, locator struct<page:int,slide:int,video_span:struct<start:double,end:double>,para:int>"
    rows = [(f"s{i}", "v", "word " * 10, (None, None, (float(i), float(i + 1)), None)) for i in range(5)] + [("p", "d", "x", (1, None, None, None))]
    got = [(r.first_id, r.n, r.start, r.end) for r in D.merge_spans(spark.createDataFrame(rows, seg), target=25).orderBy("bucket").collect()]
    assert got == [("s0", 2, 0.0, 2.0), ("s2", 2, 2.0, 4.0), ("s4", 1, 4.0, 5.0)]
