import io
import json
import os
import shutil
import zipfile

from pyspark.sql import functions as F

from pressloom.operators import manifest as M
from pressloom.operators import reports as L
from pressloom.sources import files as A
from pressloom.sources import legacy
from pressloom.streaming import ingest, quotas


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pptx(*slides):
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, s in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="{a}"><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", f'<p xmlns:a="{a}"><a:p><a:r><a:t>note</a:t></a:r></a:p></p>')
    return out.getvalue()


def test_discover_and_extract(spark, tmp_path):
    root = tmp_path / "in"
    for name, body in {"1_x/a.docx": docx("One", "Two"), "1_x/b.csv": b"h,i\n1,2\n", "1_x/~$a.docx": b"lock", "~tmp/c.csv": b"x", "1_x/d.pdf": b"%PDF", "1_x/e.pptx": pptx("S1", "S2"), "1_x/f.docx": b"broken", "1_x/g.exe": b"x", "1_x/._h.csv": b"x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    files = A.discover(spark, str(root))
    got = {r.source_file: r for r in A.extract(files, str(root)).collect()}
    assert sorted(got) == ["1_x/a.docx", "1_x/b.csv", "1_x/d.pdf", "1_x/e.pptx", "1_x/f.docx"]
    assert got["1_x/a.docx"].segments[0].text == "One\nTwo\na | b" and got["1_x/a.docx"].segments[0].segment_id == "1_x/a.docx#doc"
    assert got["1_x/b.csv"].segments[0].text == "h\ti\n1\t2" and got["1_x/b.csv"].segments[0].segment_id == "1_x/b.csv#sheet1"
    assert [(s.slide, s.text) for s in got["1_x/e.pptx"].segments] == [(1, "S1\n[notes] note"), (2, "S2")]
    assert "no text" in got["1_x/d.pdf"].error and "BadZipFile" in got["1_x/f.docx"].error


def test_pages(spark):
    df = spark.createDataFrame([("a\fb",), ("a\n---\nb\n----- \nc",), ("x",)], "t string")
    assert [r[0] for r in df.select(F.size(A.split_pages(F.col("t")))).collect()] == [2, 3, 1]
    s = spark.createDataFrame([("s", "first page of text\fno\fsecond page ![i](data:x;y) text")], "segment_id string, text_original string")
    assert [(r.page, r.text, r.language) for r in A.repaired(s).collect()] == [(1, "first page of text", "en"), (3, "second page  text", "en")]


def test_artifacts_skip_corrupt(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"chunk_id": "1", "text": "t"}, {"chunk_id": "2"}]))
    (tmp_path / "a" / "y.json").write_text("{broken")
    assert sorted(r.chunk_id for r in A.artifacts(spark, str(tmp_path / "a")).collect()) == ["1", "2"]


def test_ontology_text():
    types, relations, aliases = A.ontology("node_types: {A: {}, B: {}}\nrelationship_types:\n  R: {from: A, to: [A, C]}\naliases: {X: [y]}")
    assert relations == {"R": (["A"], ["A", "C"])} and aliases == {"X": ["y"]} and A.undeclared(types, relations) == ["C"]


def test_manifest(spark):
    log = spark.createDataFrame([("p", "s1", {"extract": "done"}, 1.0), ("p", "s2", {"extract": "done", "chunk": "failed"}, 2.0), ("q", "s", {"chunk": "done"}, 5.0), ("q", "s", {"chunk": "done"}, 5.0)], "path string, sha1 string, stages map<string,string>, updated double")
    files = spark.createDataFrame([("p", "s1"), ("p", "s2"), ("q", "s"), ("r", "s")], "path string, sha1 string")
    assert {(r.path, r.sha1) for r in M.pending(files, log, "extract").collect()} == {("p", "s1"), ("q", "s"), ("r", "s")}
    assert {(r.stage, r.state): r.n for r in M.summary(log).collect()} == {("extract", "done"): 1, ("chunk", "failed"): 1, ("chunk", "done"): 1}


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    n = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    once = M.upsert(t, n, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, M.upsert(once, n, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_cache_rules(spark):
    rows = [("paid/m1/p2", "paid/m1/p2", True), ("paid/m9/p2", "paid/m1/p2", True), ("fixture/m/p2", "paid/m1/p2", False), ("paid/m1/p1", "paid/m1/p2", False), ("fixture/a/p2", "fake/b/p2", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert [r.x for r in df.select(M.reusable(F.col("a"), F.col("b")).alias("x")).collect()] == [w for *_, w in rows]


def test_inventory_and_verify(spark):
    a = spark.createDataFrame([("x", 1, "s"), ("y", 1, "t")], "path string, length long, sha256 string")
    b = spark.createDataFrame([("x", 1, "s2"), ("z", 1, "t")], "path string, length long, sha256 string")
    assert {r.path: r.problem for r in M.verify(a, b).collect()} == {"x": "changed", "y": "missing", "z": "unexpected"}


def test_quota_refusals_take_no_room(spark):
    ok, held = quotas.accept([0, 1, 2, 3, 11, 12, 13], [], 2, 10)
    assert ok == [True, True, False, False, True, True, False] and held == [11, 12]
    rows = [(i, u, f"2024-01-01 00:00:{s:02}") for i, (u, s) in enumerate([(1, 0), (1, 1), (1, 2), (2, 2), (1, 11), (1, 12), (1, 13)])]
    e = spark.createDataFrame(rows, "event_id long, user long, t string").select("event_id", "user", F.to_timestamp("t").alias("ts"))
    got = {r.event_id: r.accepted for r in quotas.accepted(e, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: False}
    assert {r.event_id: r.in_window for r in quotas.trailing_count(e, 10).collect()}[4] == 3


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + 7 * i) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, user long, s long").select("event_id", "user", F.timestamp_seconds("s").alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = quotas.accept_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 2, 60)
    q = s.writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.accepted for r in spark.table("accepted").collect()}
    assert got == {r.event_id: r.accepted for r in quotas.accepted(e, 2, 60).collect()}


def test_follow_folder(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    os.makedirs(src)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    for n, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 1)]]):
        with open(f"{src}/{n}.json", "w") as f:
            f.write("\n".join(json.dumps({"source_file": k, "v": v}) for k, v in rows))
        ingest.follow(spark, src, out, cp, "source_file string, v int").awaitTermination(120)
    for _ in range(2):
        assert {r.source_file: r.v for r in ingest.current(spark, out).collect()} == {"a": 1, "b": 2, "c": 1}
        ingest.compact(spark, out)
        assert spark.read.parquet(out).count() == 3 and len([x for x in os.listdir(out) if x.startswith("batch=")]) == 1
    shutil.rmtree(out)


def test_scores(spark):
    q = spark.createDataFrame([(1, ["10", "11"], "x", "en"), (2, ["3"], "y", "te"), (3, [], "y", "te")], "qid long, meets array<string>, kind string, lang string")
    p = spark.createDataFrame([(1, 1, "1"), (1, 2, "2"), (1, 3, "10"), (1, 4, "10")], "qid long, rank int, press_meet_id string")
    s = L.score_retrieval(q, p)
    got = {r.qid: (r.meet_rank, r.reciprocal_rank, r.recall, r.precision) for r in s.collect()}
    assert got == {1: (3, 1 / 3, 0.5, 0.5), 2: (None, 0.0, 0.0, 0.0), 3: (None, 0.0, 0.0, 0.0)}
    agg = {(r.kind, r.lang): (r.n, r.meet_hit_rate) for r in L.aggregate_scores(s.join(q.select("qid", "kind", "lang"), "qid")).collect()}
    assert agg[("all", "all")] == (3, 0.333) and agg[("x", "all")] == (1, 1.0) and agg[("all", "te")] == (2, 0.0)


def test_sessions(spark):
    rows = [(1, "u", "2024-01-01 00:00:00", "Q1", "A one"), (2, "u", "2024-01-01 00:10:00", "Q2", "A two"), (3, "u", "2024-01-01 02:00:00", "Q3", "else")]
    e = spark.createDataFrame(rows, "event_id long, user string, t string, question string, answer string").select("*", F.to_timestamp("t").alias("ts"), F.lit(1.0).alias("latency_s"), F.lit(1).alias("uncited"), F.lit(0).alias("invalid"), F.lit(False).alias("refused"))
    turns = L.sessionize(e)
    got = {(r.session_id): (r.title, r.turns, r.last_question, r.uncited_sentences) for r in L.sessions(turns).collect()}
    assert got == {1: ("Q1", 2, "Q2", 2), 2: ("Q3", 1, "Q3", 1)}
    assert [r.turns for r in L.search_sessions(turns, "TWO").collect()] == [2]


def test_login_throttle(spark):
    rows = [(i, "u", "ip", 1000 + i, ok) for i, ok in enumerate([False, False, False, True, False])]
    e = spark.createDataFrame(rows, "event_id long, user string, ip string, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.blocked for r in quotas.failures(e, limit=2, seconds=60).where("by = 'user'").collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False}


def pdf(*pages, packed=False):
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>", "<< /Type /Font /Subtype /Type1 >>", "<< /Type /Font /ToUnicode 5 0 R >>"]
    cmap = b"1 beginbfrange <0001> <0003> <0C05> endbfrange 1 beginbfchar <0009> <0020> endbfchar"
    out = [b"%PDF-1.4\n"] + [f"{n} 0 obj {o} endobj\n".encode() for n, o in enumerate(objects, 1)]
    out.append(b"5 0 obj << /Length 1 >> stream\n" + cmap + b"\nendstream endobj\n")
    for i, p in enumerate(pages):
        body = zlib.compress(p) if packed else p
        out.append(f"{10 + 2 * i} 0 obj << /Type /Page /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj << {'/Filter /FlateDecode' if packed else ''} >> stream\n".encode() + body + b"\nendstream endobj\n")
    return b"".join(out)


def ole(stream):
    import struct

    sector = 512
    size = -(-max(len(stream), 4096) // sector)
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(size - 1)] + [0xFFFFFFFE]
    entry = lambda name, kind, start, n: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(name) + 2) + bytes([kind]) + b"\0" * 49 + struct.pack("<II", start, n) + b"\0" * 4
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * 432
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, 2, len(stream.ljust(4096, b"\0")))).ljust(sector, b"\0")
    return head[:512] + struct.pack(f"<{len(fat)}I", *fat).ljust(sector, b"\xff") + directory + stream.ljust(size * sector, b"\0")


def xlsx():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<w xmlns="{s}"><sheets><sheet name="Dues"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", f'<s xmlns="{s}"><si><t>name</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", f'<w xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></w>')
    return out.getvalue()


def test_pdf_text_layers():
    a = b"BT /F1 12 Tf 10 700 Td (The water \\(dues\\) rose) Tj 0 -14 Td [(in Ram) -20 (pur) -400 (today)] TJ ET"
    b = b"BT /F2 12 Tf <000100020003000900010002000300010002> Tj ET"
    for packed in (False, True):
        got = legacy.read_pdf(pdf(a, b"BT /F1 9 Tf (short) Tj ET", b * 2, packed=packed))
        assert got[0] == (1, "The water (dues) rose\nin Rampur today") and [n for n, _ in got] == [1, 3] and got[1][1].startswith("అఆఇ అఆఇ")
    assert legacy.pdf_reader(lambda c: [(2, "recognised second page"), (1, "recognised first page")])(b"x") == [(1, "recognised first page"), (2, "recognised second page")]

    def broken(content):
        raise OSError("no service")

    assert legacy.pdf_reader(broken)(pdf(a))[0][0] == 1
    for bad, error in ((pdf(b""), RuntimeError), (b"no", ValueError)):
        try:
            legacy.pdf_reader(broken)(bad)
            raise AssertionError
        except error:
            pass


def test_word_and_workbooks():
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 opened\par {\b Two} lines\line \u3077?\{x\}}"
    assert legacy.read_doc(rtf) == [(None, "Café opened\nTwo lines\n" + chr(3077) + "{x}")]
    import struct

    body = b"\0" * 0x18 + struct.pack("<II", 64, 64 + 21) + b"\0" * 32 + b"First line\rCell\x07End\x01."
    assert legacy.read_doc(ole(body))[0][1].split("\n")[:2] == ["First line", "Cell"]
    assert legacy.read_xlsx(xlsx()) == [(1, "# Sheet: Dues\nname\t\t7\n\tx")]


def test_readers_with_seams(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.png").write_bytes(b"i")
    (root / "b.mp3").write_bytes(b"v")
    (root / "c.doc").write_bytes(b"{\\rtf1 " + "Äâå".encode("cp1252") * 30 + b"}")
    (root / "d.pdf").write_bytes(pdf(b"BT /F1 1 Tf (A page with some text) Tj ET"))
    readers = {"png": A.image_reader(lambda c: [(1, "a clip")]), "mp3": A.speech_reader(lambda c: [(0.0, 2.504, "they said"), (3.0, 4.0, " ")])}
    got = {r.source_file: r for r in A.checked(A.extract(A.discover(spark, str(root)), str(root), readers)).collect()}
    assert got["a.png"].segments[0].segment_id == "a.png#doc" and (got["b.mp3"].segments[0].start, got["b.mp3"].segments[0].end) == (0.0, 2.5)
    assert got["c.doc"].segments == [] and "legacy font" in got["c.doc"].error and got["d.pdf"].segments[0].page == 1
    w = A.speech_windows(spark.createDataFrame([("b", 60.0), ("z", 0.0)], "path string, duration double")).orderBy("n").collect()
    assert [(r.start, r.end) for r in w] == [(0.0, 25.0), (25.0, 50.0), (50.0, 60.0)]
    n = spark.createDataFrame([(["a.json", "b.md"],), (["a.json"],)], "n array<string>").select(A.text_files(F.col("n")).alias("n"))
    assert [r.n for r in n.collect()] == [["b.md"], ["a.json"]]


def test_question_set():
    assert A.question_set("- {id: a, q: ' What? ', meets: [1]}")[0] == {"id": "a", "q": "What?", "lang": "en", "kind": "single", "meets": ["1"], "entities": []}
    for bad in ("- {q: x}", "- {id: a, q: x}\n- {id: a, q: y}", "[]", "- {id: a, q: ''}"):
        try:
            A.question_set(bad)
            raise AssertionError
        except ValueError:
            pass
