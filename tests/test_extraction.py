import random
from pressloom.operators import extraction as X
from pressloom.operators.graph import legal_triples


def plain_pieces(text, limit):
    """The rule itself: the last line break, else the last space, of the second half of the room."""
    out, at = [], 0
    while len(text) - at > limit:
        room = text[at : at + limit]
        found = [i for c in "\n " for i in [room.rfind(c, limit // 2)] if i > 0]
        out.append(text[at : at + (found[0] if found else limit)])
        at += found[0] if found else limit
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def test_pieces_prefer_line_breaks(spark):
    rng = random.Random(3)
    texts = ["a" * 60 + "\n" + "b" * 30 + " " + "c" * 80, "x" * 250, "", "   ", None, *("".join(rng.choice("ab  \nతి") for _ in range(rng.randrange(700))) for _ in range(40))]
    got: dict = {}
    for r in X.pieces(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string"), 100).collect():
        got.setdefault(int(r.chunk_id), []).append((r.piece_id, r.text))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, []), key=lambda p: int(p[0].partition("#s")[2] or 0))] == plain_pieces(t or "", 100), i


def test_pieces_and_cache(spark):
    df = spark.createDataFrame([("c1", "short"), ("c2", "w " * 200), ("c3", None), ("c4", " ")], "chunk_id string, text string")
    p = X.pieces(df, 100)
    ids = sorted(r.piece_id for r in p.collect())
    assert ids[0] == "c1" and ids[1] == "c2#s0" and all(len(r.text) <= 100 for r in p.collect())
    assert X.outstanding(p, p.where("chunk_id = 'c1'")).where("chunk_id = 'c1'").count() == 0


def test_model_output_is_checked(spark):
    df = spark.createDataFrame([("c1", "ok"), ("c2", "fail"), ("c3", "ok")], "chunk_id string, text string")

    def make():
        def model(t):
            if t == "fail":
                raise RuntimeError("no")
            return {
                "entities": [{"name": "Asha", "type": "Person"}, {"name": "ASHA.", "type": "Person"}, {"name": "Rampur", "type": "Place"}, {"name": "X", "type": None}, {"name": "", "type": "Person"}, {"name": "Y", "type": "Odd"}],
                "relations": [{"source": "Asha", "relation": "LIVES", "target": "Rampur", "evidence": "e" * 500}, {"source": "asha", "relation": "LIVES", "target": "rampur", "evidence": "f"}, {"source": "Rampur", "relation": "LIVES", "target": "Asha", "evidence": ""}, {"source": "Asha", "relation": "LIVES", "target": "Nowhere", "evidence": ""}],
            }

        return model

    r = X.run_model(X.pieces(df), make, 2).persist()
    assert sorted(bool(x.error) for x in r.collect()) == [False, True]
    e = X.entities(r, ["Person", "Place"])
    assert sorted((x.name, x.issue) for x in e.collect() if x.issue is None) == [("Asha", None), ("Rampur", None)]
    assert sorted(x.issue for x in e.collect() if x.issue) == ["unknown_type", "unnamed", "untyped"]
    rel = X.relations(r, e, legal_triples({"LIVES": (["Person"], ["Place"])}, spark)).collect()
    assert [(x.source_id, x.target_id, len(x.evidence)) for x in rel if not x.issue] == [("Person:asha", "Place:rampur", 400)]
    assert sorted(x.issue for x in rel if x.issue) == ["illegal_triple", "unresolved_end"]


def test_resolve_is_exact_and_typed(spark):
    rows = [("1", "Person", "Smt. Asha Rao", 2), ("2", "Person", "asha rao", 9), ("3", "Person", "A. Rao", 1), ("4", "Place", "Asha Rao", 1), ("5", "Person", "ఆశ", 50), ("6", "Person", "Asha", 1), ("7", "Person", None, 1)]
    n = spark.createDataFrame(rows, "entity_id string, type string, name string, mention_count int")
    a = spark.createDataFrame([("ఆశ", "Asha Devi"), ("Asha", "Asha Devi")], "surface string, canonical string")
    got: dict = {}
    for r in X.resolve(n, a).collect():
        got.setdefault(r.resolved_id, set()).add((r.entity_id, r.display))
    assert sorted(sorted(g) for g in got.values()) == [[("1", "asha rao"), ("2", "asha rao")], [("3", "A. Rao")], [("4", "Asha Rao")], [("5", "Asha Devi"), ("6", "Asha Devi")]]


def test_offline_providers(spark):
    df = spark.createDataFrame([("a", "water dues"), ("b", "water dues"), ("c", None)], "chunk_id string, text string")
    v = {r.chunk_id: list(r.vector) for r in X.embed(df, "chunk_id", "text").collect()}
    assert v["a"] == v["b"] and len(v["a"]) == 64 and sum(map(abs, v["a"])) == 2 and "c" not in v
    assert X.extractive("water dues?", [(1, "Buses ran. The water dues rose."), (2, "Nothing.")]) == "The water dues rose [1]."
