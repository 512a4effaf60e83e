"""Token passages, extraction into the graph, retries, history, answer scores and listings."""

import random

import pytest
from pyspark.sql import functions as F

from pressloom.operators import chunking as D
from pressloom.operators import extraction as X
from pressloom.operators import graph as G
from pressloom.operators import manifest as T
from pressloom.operators import ranking as R
from pressloom.operators import reports as L
from pressloom.streaming import history as H


def word_spans(text):
    import re

    return [m.span() for m in re.finditer(r"\S+", text)]


def test_token_passages_stay_under_the_ceiling(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) + (". " if rng.random() < 0.1 else "") + ("\n\n" if rng.random() < 0.01 else "") for _ in range(5000)).strip()
    own = D.split_tokens(text, word_spans(text))
    assert all(len(p.split()) <= D.CEILING for p in own) and own[0] == text[: len(own[0])] and text.endswith(own[-1])
    at = 0
    for p in own:  # nothing between two pieces is lost
        found = text.find(p, max(0, at - 2000))
        assert 0 <= found and not text[at:found].strip()
        at = found + len(p)
    assert all(p[-1] == "." or text[text.find(p) + len(p) :].lstrip(" ").startswith("\n\n") for p in own[:-1])
    assert D.split_tokens("a b", word_spans("a b")) == ["a b"] and D.split_tokens("", []) == []
    tail = "w " * 1400 + "x " * 40
    assert len(D.split_tokens(tail.strip(), word_spans(tail.strip()), target=1380, overlap=10, ceiling=1450)) == 1
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "one two")], "id long, t string")
    got = D.token_passages(df, "id", "t", lambda: word_spans).collect()
    assert sum(r.item_id == 1 for r in got) == len(own) and [r.text for r in got if r.item_id == 4] == ["one two"] and {r.item_id for r in got} == {1, 4}


def test_records_become_a_graph(spark):
    chunks = spark.createDataFrame([("c1", "h1", "f1", "10", "2025-01-01", "p.1"), ("c2", "h1", "f2", "", None, "p.2"), ("c3", "", "f3", "11", "2025-02-01", "p.3"), ("c4", "h9", "f4", "12", None, "p.4")], "chunk_id string, content_hash string, source_file string, press_meet_id string, date string, citation string")
    records = spark.createDataFrame([("h1", [("Asha Rao", "Person"), ("Water dues", "Issue")], [("asha rao", "ACCUSES", "Water dues", "she said")], None), ("c3", [("Smt. Asha Rao", "Person")], [], None)], f"content_hash string, {X.RECORD}, error string")
    triples = spark.createDataFrame([("MENTIONS", "PressMeet", "Person"), ("ACCUSES", "Person", "Issue")], "relation string, source_type string, target_type string")
    known = X.entities(records, ["Person", "Issue"])
    stated = X.relations(records, known, triples)
    canonical = spark.createDataFrame([("Person", "asha rao", "Asha Rao")], "type string, key string, display string")
    observed, asserted = G.load_records(chunks, records, known, stated, canonical, triples)
    nodes = {r.entity_id: r for r in G.merge_entities(observed).collect()}
    assert set(nodes) == {"Person:asha rao", "Issue:water dues"} and nodes["Person:asha rao"].mention_count == 3 and nodes["Person:asha rao"].press_meet_ids == ["10", "11", "unknown"]
    edges = {(r.source_id, r.relation, r.target_id): r.weight for r in G.collapse_relations(asserted).collect()}
    assert edges["Person:asha rao", "ACCUSES", "Issue:water dues"] == 2 and edges["PressMeet:10", "ABOUT_ISSUE", "Issue:water dues"] == 1 and edges["Source:f2", "RELATED_TO_ISSUE", "Issue:water dues"] == 1 and edges["PressMeet:11", "MENTIONS", "Person:asha rao"] == 1
    assert not any(k[1] == "MENTIONS" and k[2].startswith("Issue") for k in edges)
    few, _ = G.load_records(chunks, records, known, stated, canonical, triples, least=3)
    assert {r.entity_id for r in few.collect()} == {"Person:asha rao"}
    assert {r.chunk_id for r in X.with_records(chunks, records).collect()} == {"c1", "c2", "c3"}


def test_retries_and_halves():
    class Status(Exception):
        def __init__(self, status):
            self.status = status

    def failing(*answers):
        left = list(answers)

        def call(text):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return call

    slept = []
    assert X.persistent(failing(Status(429), OSError(), {"a": 1}), sleep=slept.append)("t") == {"a": 1} and len(slept) == 2 and slept[1] > slept[0]
    with pytest.raises(Status):
        X.persistent(failing(Status(404), {"a": 1}), sleep=slept.append)("t")
    with pytest.raises(OSError):
        X.persistent(failing(OSError(), OSError()), attempts=2, sleep=slept.append)("t")
    text = "word " * 300
    asked = []
    half = X.halving(lambda t: asked.append(t) or (None if len(t) > 1000 else {"entities": [len(t)], "relations": []}))
    assert len(half(text)["entities"]) == 2 and len(asked) == 3 and all(not t.endswith("wor") for t in asked)
    with pytest.raises(ValueError):
        X.halving(lambda t: None)("short")


def test_history(spark, tmp_path):
    folder = str(tmp_path / "turns")
    row = lambda u, s, n, q: (u, s, n, None, q, f"answer {n}", [1], 0, 0, False, 1.0)
    kind = "user string, session_id string, turn int, ts timestamp, question string, answer string, cited array<int>, uncited int, invalid int, refused boolean, latency_s double"
    H.append_turns(spark.createDataFrame([row("u1", "s1", 1, "What  about dues? " * 9), row("u2", "s9", 1, "Other")], kind), folder)
    H.append_turns(spark.createDataFrame([row("u1", "s1", 2, "And then?"), row("u1", "s2", 1, "New")], kind), folder)
    own = {(r.session_id, r.turn): r.title for r in H.turns(spark, folder, "u1").collect()}
    assert own["s1", 1].startswith("What about dues? What") and len(own["s1", 1]) == 70 and own["s1", 2] is None and own["s2", 1] == "New"
    assert H.rename_session(spark, folder, "u1", "s1", "  Water   dues ") == "Water dues"
    assert [r.title for r in H.turns(spark, folder, "u1").where("session_id = 's1' and turn = 1").collect()] == ["Water dues"]
    with pytest.raises(ValueError):
        H.rename_session(spark, folder, "u1", "s1", "  ")
    H.delete_session(spark, folder, "u1", "s1")
    assert {r.session_id for r in H.turns(spark, folder).collect()} == {"s2", "s9"}
    H.delete_user(spark, folder, "u1")
    assert {r.user for r in H.turns(spark, folder).collect()} == {"u2"}
    assert H.append_log(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log")) and spark.read.json(str(tmp_path / "log")).count() == 1
    (tmp_path / "file").write_text("x")
    assert not H.append_log(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "file" / "log"))


def test_scores_of_answers(spark):
    q = spark.createDataFrame([(1, ["10"], ["laddu", ""]), (2, ["11"], ["Rao"]), (3, [], None)], "qid long, meets array<string>, entities array<string>")
    linked = spark.createDataFrame([(1, "TTD  Laddu"), (2, "Devi")], "qid long, name string")
    assert {r.qid: r.entity_hit for r in L.entity_hits(q, linked).collect()} == {1: True, 2: False, 3: False}
    a = spark.createDataFrame([(1, "x [1].", [1], [], 0, None), (2, "y", [2], [9], 1, "invalid_citations")], "qid long, answer string, cited array<int>, invalid array<int>, uncited int, refused string")
    s = spark.createDataFrame([(1, 1, "10"), (2, 2, "10")], "qid long, n int, press_meet_id string")
    assert {r.qid: (r.cited_expected_meet, r.refused, r.invalid) for r in L.score_answers(q, a, s).collect()} == {1: (True, False, 0), 2: (False, True, 1)}
    p = spark.createDataFrame([(1, r, "10", "c", "video", "te") for r in range(1, 9)], "qid long, rank int, press_meet_id string, citation string, source_type string, language string")
    assert [x.rank for x in L.top_passages(p).first().top] == [1, 2, 3, 4, 5]
    m = [{"kind": "all", "lang": "all", "n": 2, "meet_hit_rate": 0.5, "mrr": 0.4, "recall": 0.3, "precision": 0.2}]
    assert "| all | all | 2 | 0.500 (+0.100) | 0.400 | 0.300 | 0.200 |" in L.markdown(m, [m[0] | {"meet_hit_rate": 0.4}])
    y = L.yields(spark.createDataFrame([("h", ["a"], [], None, 2), ("i", [], ["r"], "E", 1)], "content_hash string, entities array<string>, relations array<string>, error string, calls int"), 60).first()
    assert (y.units, y.units_per_minute, y.calls_per_unit, y.share_without_error) == (2, 2.0, 1.5, 0.5)


def test_tables_kept_beside(spark, tmp_path):
    n = spark.createDataFrame([("P:a", "A", "Person", 3)], "entity_id string, name string, type string, mention_count int")
    c = spark.createDataFrame([("c0000", 2, "P:a"), ("c0000", 2, "P:b"), ("c0001", 1, "P:c")], "community_id string, size long, node string")
    G.save(n, n, c, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/communities")).count() == 3 and [tuple(r) for r in G.community_list(c, 2).collect()] == [("c0000", 2)]
    s = spark.createDataFrame([("extract", "files", 1), ("chunk", "chunks", 2)], "stage string, name string, value long")
    assert sorted(map(tuple, T.set_stage(s, "extract", {"files": 5, "errors": 0}).collect())) == [("chunk", "chunks", 2), ("extract", "errors", 0), ("extract", "files", 5)]


def test_vector_search_collapses_copies(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.9, 0.1]), ("d", [0.0, 1.0])], "chunk_id string, vector array<float>")
    c = spark.createDataFrame([("a", "h", "f1"), ("b", "h", "f2"), ("c", "", "f3"), ("d", None, "f4")], "chunk_id string, content_hash string, citation string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>")
    assert [(r.chunk_id, list(r.duplicates)) for r in R.vector_search(v, q, c, 2).orderBy("rank").collect()] == [("a", ["f2"]), ("c", [])]


def test_kept_tables_follow_their_files(spark, tmp_path):
    from pressloom.session import kept

    path = str(tmp_path / "t.parquet")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(path).select((F.col("id") * 2).alias("x"))

    spark.range(3).write.parquet(path)
    assert sorted(r.x for r in kept(spark, "twice", [path], build).collect()) == [0, 2, 4]
    assert kept(spark, "twice", [path], build).count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert kept(spark, "twice", [path], build).count() == 5 and len(made) == 2
