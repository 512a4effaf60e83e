import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import ranking as R
from pressloom.operators.filters import Filters, glob
from pressloom.plans.retrieve import passages

CHUNK = "chunk_id string, text string, citation string, source_type string, source_file string, content_hash string, press_meet_id string, date string, language string, publication string"


def chunk(i, text="", **k):
    row = dict(chunk_id=i, text=text, citation=f"cite {i}", source_type="source_doc", source_file=f"{i}.pdf", content_hash="", press_meet_id="1", date="2024-01-01", language="en", publication=None) | k
    return tuple(row.values())


def test_fusion_prefers_agreement_and_keeps_ranks(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "c", 3)], "qid long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "b", 2), (1, "c", 3)], "qid long, chunk_id string, rank int")
    rows = R.fuse({"vector": (a, 1.0), "keyword": (b, 1.0)}).orderBy(F.desc("score"), "chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["b", "c", "x", "y"]
    assert rows[0].ranks == {"vector": 2, "keyword": 2}


def test_dedup_keeps_best_and_cites_copies(spark):
    rows = [(1, "1", "h", "f1", 1), (1, "2", "h", "f2", 2), (1, "3", "g", "f3", 3), (1, "4", "", "f4", 4), (1, "5", None, "f5", 5)]
    df = spark.createDataFrame(rows, "qid long, chunk_id string, content_hash string, citation string, pos int")
    got = {r.chunk_id: list(r.duplicates) for r in R.dedup(df, 10).collect()}
    assert got == {"1": ["f2"], "3": [], "4": [], "5": []}


def test_diversify_caps_then_fills(spark):
    rows = [(1, f"a{i}", "a.pdf", i) for i in range(4)] + [(1, "b", "b.pdf", 4)]
    df = spark.createDataFrame(rows, "qid long, chunk_id string, source_file string, pos int")
    got = [r.chunk_id for r in R.diversify(df, 4).orderBy("pos").collect()]
    assert got == ["a0", "a1", "b", "a2"]


def test_budget_always_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 10), (2, 1, 5), (2, 2, 5), (2, 3, 1)], "qid long, pos int, size int")
    assert sorted((r.qid, r.pos) for r in R.budget(df, 10, "size").collect()) == [(1, 1), (2, 1), (2, 2)]


def test_intents(spark):
    for q, want in (("What did he say in court?", "attribution"), ("Which court order?", "documentary"), ("water dues", "general")):
        assert spark.createDataFrame([(q,)], "q string").select(R.intent(F.col("q"))).first()[0] == want


def test_vector_topk_is_exact_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(f"{i:03}", [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id string, vector array<float>").repartition(5)
    q = df.where("chunk_id in ('003', '050')").select(F.col("chunk_id").cast("long").alias("qid"), "vector")
    got = {(r.qid, r.rank): r.chunk_id for r in R.vector_topk(df, q, 5).collect()}
    n = v.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for i in (3, 50):
        want = sorted(range(200), key=lambda j: (-round(float(n[i] @ n[j]), 6), f"{j:03}"))[:5]
        assert [got[i, k] for k in range(1, 6)] == [f"{j:03}" for j in want]
    assert R.vector_topk(df, q, 3, block=1).count() == 6


def test_dimension_mismatch_names_both(spark):
    a = spark.createDataFrame([("a", [1.0] * 4)], "chunk_id string, vector array<float>")
    b = spark.createDataFrame([(1, [1.0] * 3)], "qid long, vector array<float>")
    with pytest.raises(ValueError, match="4.*3"):
        R.check_dimension(a, b)


def test_filters(spark):
    df = spark.createDataFrame([chunk("a"), chunk("b", language="te"), chunk("c", language="te", date=None)], CHUNK)
    assert not Filters().active and Filters().apply(df).count() == 3
    assert [r.chunk_id for r in Filters(language="te", since="2023-01-01").apply(df).collect()] == ["b"]
    assert Filters(language="o'x").apply(df).count() == 0
    assert [r.chunk_id for r in df.where(glob(F.col("source_file"), "?.pd*")).collect()] == ["a", "b", "c"]


def test_passages_end_to_end(spark):
    df = spark.createDataFrame([chunk("a", "milk union water dues"), chunk("b", "milk union water dues", content_hash="h"), chunk("c", "milk union water dues", content_hash="h"), chunk("d", "bus routes"), chunk("e", None)], CHUNK)
    q = spark.createDataFrame([(1, "water dues?"), (2, "nothing here matches zzz")], "qid long, q string")
    got = passages(df, q, k=3).orderBy("qid", "rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"] and got[1].duplicates == ["cite c"]
    assert passages(df.limit(0), q).count() == 0
    v = spark.createDataFrame([("d", [1.0, 0.0]), ("a", [0.0, 1.0])], "chunk_id string, vector array<float>")
    qv = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, vector array<float>")
    assert {r.chunk_id for r in passages(df, q, k=4, vectors=v, question_vectors=qv).where("qid = 1").collect()} == {"a", "b", "d"}


def test_sources_put_promoted_chunks_first_and_number_once(spark):
    from pressloom.operators import answer as K

    p = spark.createDataFrame([(1, r, f"c{r}", "text " * 10, f"cite {r}", "2025-01-01") for r in range(1, 4)], "qid long, rank int, chunk_id string, text string, citation string, date string")
    ev = "array<struct<chunk_id:string,quote:string,citation:string,date:string>>"
    f = spark.createDataFrame([(1, 1, "a", "ACCUSES", "b", "A", "B", False, [("x9", "the amount of 5 crore", "f1", None)]), (1, 2, "a", "MENTIONS", "c", "A", "C", True, [("x8", "q", "f2", None)])], f"qid long, n int, source_id string, relation string, target_id string, source string, target string, structural boolean, evidence {ev}")
    chunks = spark.createDataFrame([("x9", "before " * 200 + "the amount of 5 crore was paid", "file9"), ("x8", "q", "file8")], "chunk_id string, text string, citation string")
    up = K.promoted(f, p, chunks)
    assert [(r.chunk_id, "5 crore" in r.text) for r in up.collect()] == [("x9", True)]
    rows = K.sources(p, f, up).orderBy("n").collect()
    assert [(r.n, r.kind, r.chunk_id) for r in rows] == [(1, "passage", "x9"), (2, "passage", "c1"), (3, "passage", "c2"), (4, "passage", "c3"), (5, "fact", "x9"), (6, "fact", "x8")]
    tight = K.prompt_sources(K.all_sources(p, f, up), 300).orderBy("n").collect()
    assert [(r.kind, r.chunk_id) for r in tight] == [("passage", "x9"), ("fact", "x9"), ("fact", "x8")]
    q = spark.createDataFrame([(1, "What did A say?")], "qid long, q string")
    prompt = K.prompts(q, K.sources(p, f, up)).first()
    assert prompt.language == "English" and "[5] (fact) f1" in prompt.prompt and "Supporting quote" in prompt.prompt
    made = {judge: K.answers(K.prompts(q, K.sources(p, f)), K.sources(p, f), lambda: lambda text, own: "A paid 5 crore [1].", (lambda: lambda what, text: judge == "yes") if judge else None).first() for judge in ("yes", "no", None)}
    assert made["yes"].refused is None and made["yes"].answer == "A paid 5 crore [1]." and {made["no"].refused, made[None].refused} == {"insufficient_evidence"}


def test_answer_language(spark):
    from pressloom.operators import answer as K

    df = spark.createDataFrame([("What?", None), ("ఏమిటి జరిగింది", None), ("What?", "te"), ("What?", " Tamil "), ("123", "")], "q string, c string")
    assert [r[0] for r in df.select(K.answer_language(F.col("q"), F.col("c"))).collect()] == ["English", "Telugu", "Telugu", "Tamil", "English"]


def test_many_questions_share_their_terms_and_find_the_same(spark):
    rng = np.random.default_rng(2)
    common, rare = ["power", "water", "dues", "board"], [f"name{i}" for i in range(60)]
    text = lambda: " ".join([*rng.choice(common, rng.integers(0, 5)), *rng.choice(rare, rng.integers(1, 6)), *["filler"] * rng.integers(0, 4)])
    texts = [text() for _ in range(400)]
    chunks_ = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts + texts[:100])], "chunk_id string, text string")
    asked = [(i, " ".join([*rng.choice(common, 3, replace=False), *rng.choice(rare, i % 4), *["unknown"] * (i % 2)])) for i in range(200)] + [(200, "power"), (201, "nothing known"), (202, "")]
    q = spark.createDataFrame(asked, "qid long, q string")
    index = R.postings(chunks_)
    for given in (index, R.with_frequencies(index)):
        plain = {(r.qid, r.rank): (r.chunk_id, r.score) for r in R.bm25(given, q, 7).collect()}
        shared = {(r.qid, r.rank): (r.chunk_id, r.score) for r in R.bm25(given, q, 7, batch=0).collect()}
        assert len(plain) > 1300 and shared == plain


def test_many_vectors_are_looked_up_in_one_pass(spark):
    rng = np.random.default_rng(3)
    v, a = rng.integers(-2, 3, (3000, 6)), rng.integers(-1, 2, (5000, 6))
    v[v.any(axis=1) == 0, 0] = 1
    a[a.any(axis=1) == 0, 0] = 1
    df = spark.createDataFrame([(f"{i:04}", [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id string, vector array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "qid long, vector array<float>")
    top = R.vector_topk(df, q, 4)
    assert top._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.qid, r.rank): (r.chunk_id, r.score) for r in top.collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(a.astype(float)) @ unit(v.astype(float)).T, 6)
    assert len(got) == 4 * 5000
    for i in range(0, 5000, 7):
        want = sorted(range(3000), key=lambda j: (-s[i, j], j))[:4]
        assert [got[i, n + 1] for n in range(4)] == [(f"{j:04}", s[i, j]) for j in want]


def test_texts_are_not_ranked(spark):
    from pressloom.plans import retrieve as P

    df = spark.createDataFrame([chunk("a", "water dues"), chunk("a", "water dues"), chunk("b", "water"), chunk("c", "bus")], CHUNK)
    q = spark.createDataFrame([(1, "water dues?")], "qid long, q string")
    rows = P.placed(df, q, 2, P.legs(df, q, 8))
    assert not {"text", "q"} & set(rows.columns)
    assert [(r.chunk_id, r.rank, r.n_keyword) for r in rows.orderBy("rank").collect()] == [("a", 1, 2), ("b", 2, 2)]
    full = P.with_texts(rows, df, q)
    assert set(P.FIELDS) <= set(full.columns) and full.count() == 2


def test_sources_of_a_prompt_are_numbered_in_one_pass(spark):
    from pressloom.operators import answer as K

    rows = [(1, n, kind, False, f"c{n}", "x" * size, "", None) for n, (kind, size) in enumerate([("passage", 9000), ("passage", 4000), ("passage", 50), ("fact", 3000), ("fact", 500), ("fact", 900)], 1)] + [(2, 1, "passage", False, "d", "y" * 20000, "", None)]
    s = spark.createDataFrame(rows, "qid long, n int, kind string, promoted boolean, chunk_id string, body string, citation string, date string")
    got = K.prompt_sources(s)
    assert [(r.qid, r.n, r.kind, r.chunk_id) for r in got.orderBy("qid", "n").collect()] == [(1, 1, "passage", "c1"), (1, 2, "fact", "c4"), (1, 3, "fact", "c5"), (2, 1, "passage", "d")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    q = spark.createDataFrame([(1, "What?"), (3, "Who?")], "qid long, q string")
    made = K.answers(K.prompts(q, got), got, lambda: lambda text, own: f"Paid {len(own)} times [3].", lambda: lambda what, text: True)
    assert {r.qid: (r.answer, r.refused) for r in made.collect()} == {1: ("Paid 3 times [3].", None), 3: (K.REFUSALS["invalid_citations"], "invalid_citations")}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3  # questions, and sources as text and as records with their prompt
