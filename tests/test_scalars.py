import json

import pytest
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.functions.text import content_hash, strip


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x if names else None


@pytest.mark.parametrize(
    "text, want",
    [("hello", "en"), ("నమస్కారం అందరికీ", "te"), ("नमस्ते दुनिया", "hi"), ("123 ...", "unknown"), ("", "unknown"), ("hello నమస్కారం", "mixed"), (None, None), ("سلام", "unknown")],
)
def test_detect_language(spark, text, want):
    assert one(spark, S.detect_language(F.col("t")), t=text) == want


@pytest.mark.parametrize("path, want", [("a/b.PDF", "source_doc"), ("x.tar.docx", "press_release"), ("clip.jpeg", "news_clip"), ("deck.ppt", "slide"), ("noext", None), ("a.b/c", None)])
def test_source_type(spark, path, want):
    assert one(spark, S.source_type(F.col("p")), p=path) == want


@pytest.mark.parametrize("text, want", [("x 3.7.2024 y", "2024-07-03"), ("99-99-2024", "2024-99-99"), ("15082024", "2024-08-15"), ("15132024", None), ("none", None), ("112082024", None)])
def test_iso_date(spark, text, want):
    assert one(spark, S.iso_date(F.col("t")), t=text) == want


def test_meet_of_path(spark):
    got = {k: one(spark, v, p="archive/10_21.06.2024_HALF-FINISHED MEDICAL/clips/a.jpg") for k, v in S.meet_of(F.col("p")).items()}
    assert got == {"press_meet_id": "10", "date": "2024-06-21", "topic": "HALF-FINISHED MEDICAL", "press_meet_title": "10_21.06.2024_HALF-FINISHED MEDICAL"}


def test_citation_label(spark):
    label = S.citation_label(F.lit("a/b.mp4"), F.lit("Daily"), F.lit(None).cast("int"), F.lit(3), F.lit(65.9), F.lit("2024-01-02"))
    assert one(spark, label, t="") == "Daily b.mp4 slide 3 @ 01:05 (2024-01-02)"
    bare = S.citation_label(F.lit("b.pdf"), F.lit(None).cast("string"), F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    assert one(spark, bare, t="") == "b.pdf p.0"


def test_content_hash_ignores_white_space(spark):
    a, b = (one(spark, content_hash(F.col("t")), t=t) for t in ("a  b\n c", " a b c "))
    assert a == b
    assert one(spark, content_hash(F.col("t")), t=None) is None


def test_strip_is_python_strip(spark):
    for t in ("　\x1c a b \x85\xa0", "", "   ", "x", "​x​"):
        assert one(spark, strip(F.col("t")), t=t) == t.strip()


@pytest.mark.parametrize("name, want", [("Smt. Ramya  Rao", "ramya rao"), ("Dr. Mr. X", "x"), ("శ్రీ రామ", "రామ"), ("A.B./C", "a b c"), ("ﬁne", "fine"), (None, ""), ("  ", "")])
def test_normalise(spark, name, want):
    assert S.normalise_name(name) == want
    assert one(spark, S.normalise(F.col("n")), n=name) == want


def test_terms_and_jaccard(spark):
    assert sorted(one(spark, S.query_terms(F.col("t")), t="What did the Milk Union say about 2024 dues, dues?")) == ["dues", "milk", "union"]
    assert one(spark, S.jaccard(F.array(), F.array()), t="") == 1.0
    assert one(spark, S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), t="") == 0.5


def test_clip_and_window(spark):
    assert one(spark, S.clip(F.col("t"), 9), t="one two three") == "one two …"
    assert one(spark, S.clip(F.col("t"), 90), t=" one  two ") == "one two"
    assert one(spark, S.evidence_window(F.col("t"), F.lit("needle"), 12), t="x" * 40 + " needle " + "y" * 40).startswith("xxx needle")


def test_misc(spark):
    assert one(spark, S.tag_density(F.col("t")), t="<b>ab</b>cd") == pytest.approx(7 / 11)
    assert one(spark, S.strip_data_uris(F.col("t")), t="a![x](data:image/png;base64,AA)b") == "ab"
    assert one(spark, S.token_estimate(F.col("t")), t="abcdefghij") == 3
    assert one(spark, S.human_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, S.human_bytes(F.col("n")), n=12) == "12 B"
    assert one(spark, S.locale(F.col("t")), t="te") == "te-IN"
    assert one(spark, S.is_latin(F.col("t")), t="abcd ఎ") is True
    assert one(spark, S.clean_ocr(F.col("t")), t="a‌b  c\n-----\n.\nx\n") == "ab c\nx"
    assert one(spark, S.publication(F.col("t"), {"jana": "Jana Swaram", "lok": "Lok Tarang"}), t="the_LOK_jana") == "Jana Swaram"


def test_json_object(spark):
    for text, want in (('{"a": 1}', 1), ('so:\n```json\n{"a": 2}\n```', 2), ('well {"a": 3} then', 3), ("nothing", None), ('{"a": ', None)):
        got = one(spark, S.json_object(F.col("t"), "a int"), t=text)
        assert (got.a if got else None) == want


@pytest.mark.parametrize("text, want", [('{"e": [{"n": 1}, {"n": 2', {"e": [{"n": 1}]}), ('{"a": 1, "b": "x', {"a": 1}), ('{"a": 1} tail', {"a": 1}), ("", None), ('{"a": [1, 2], "c": [', {"a": [1, 2], "c": []})])
def test_repair_truncated_json(text, want):
    got = S.repair_truncated_json(text)
    assert (json.loads(got) if got else None) == want
