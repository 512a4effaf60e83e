"""Files as sources: discovery, dispatch to readers, pages, artifacts, ontologies.

Formats that need a library that is not installed, or a paid service, are seams: a reader
is a function of bytes, looked up by kind. Whatever a reader raises becomes the row's error.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.sources import legacy as L

SEGMENT = "array<struct<segment_id:string,page:int,slide:int,start:double,end:double,text:string>>"
EXTRACTED = f"source_file string, source_type string, segments {SEGMENT}, error string"
ARTIFACT = "chunk_id string, text string, content_hash string, source_file string, source_type string, press_meet_id string, press_meet_title string, date string, topic string, publication string, language string, page int, slide int, citation string"
#: Fixed: rows of a sheet and least characters of a page that are kept.
SHEET_ROWS, PAGE_CHARS = 200, 12
_TEXT = ("txt", "md", "html", "json")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content, source_type) of files with a known extension,
    without temporary and lock files and whatever lies below a folder that begins with ~."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    known = files.withColumn("source_type", S.source_type(F.col("path"))).where("source_type is not null")
    return known.where(~name.rlike(r"^(?:~\$|\.~|\._)") & ~F.col("path").rlike(r"/~[^/]*/")).orderBy("path")


def read_text(content: bytes) -> list[tuple[int | None, str]]:
    return [(None, content.decode("utf-8", "replace"))]


def read_csv(content: bytes) -> list[tuple[int | None, str]]:
    rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"))))[:SHEET_ROWS]
    return [(1, "\n".join("\t".join(r) for r in rows))]


def read_docx(content: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs and table rows of a document's main part."""
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    flat = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            lines.append(flat(e))
        elif e.tag == f"{w}tbl":
            lines += [" | ".join(flat(c) for c in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    return [(None, "\n".join(x for x in lines if x))]


def read_pptx(content: bytes) -> list[tuple[int | None, str]]:
    """Text of every slide, with its notes."""
    import re
    import zipfile
    from xml.etree import ElementTree

    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    text = lambda n: "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{a}t")).strip() for p in ElementTree.fromstring(z.read(n)).iter(f"{a}p")) if x)
    numbers = sorted(int(m.group(1)) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m)
    out = []
    for n in numbers:
        body = text(f"ppt/slides/slide{n}.xml")
        notes = f"ppt/notesSlides/notesSlide{n}.xml"
        out.append((n, body + (f"\n[notes] {text(notes)}" if notes in z.namelist() else "")))
    return out


READERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {"txt": read_text, "md": read_text, "csv": read_csv, "xlsx": L.read_xlsx, "docx": read_docx, "pptx": read_pptx, "pdf": L.read_pdf, "doc": L.read_doc, "rtf": L.read_doc}


def _segment(rel: str, mark: str, n, text: str, k: int) -> dict:
    span = n if isinstance(n, tuple) else (None, None)
    name = f"{rel}#t{k}" if isinstance(n, tuple) else f"{rel}#doc" if n is None else f"{rel}#{mark}{n}"
    number = None if isinstance(n, tuple) else n
    return {"segment_id": name, "page": number if mark == "p" else None, "slide": number if mark == "s" else None, "start": span[0], "end": span[1], "text": text}


def image_reader(ocr: Callable[[bytes], list[tuple[int | None, str]]]) -> Callable[[bytes], list[tuple[int | None, str]]]:
    """A reader of images by a recogniser; a page number is kept only where there are several."""

    def read(content: bytes) -> list[tuple[int | None, str]]:
        pages = [(n, t) for n, t in ocr(content) if (t or "").strip()]
        return pages if len(pages) > 1 else [(None, t) for _, t in pages]

    return read


def speech_reader(transcribe: Callable[[bytes], list[tuple[float, float, str]]]) -> Callable[[bytes], list[tuple[tuple[float, float], str]]]:
    """A reader of recordings by a transcriber; a part is named by its rounded span in seconds."""
    return lambda content: [((round(a, 2), round(z, 2)), t) for a, z, t in transcribe(content) if t.strip()]


def speech_windows(files: DataFrame, seconds: int = 25) -> DataFrame:
    """(path, n, start, end): the windows a recording (path, duration) is transcribed in."""
    n = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / seconds).cast("int") - 1, F.lit(0)))
    flat = files.where("duration > 0").select("path", "duration", F.explode(n).alias("n"))
    return flat.select("path", "n", (F.col("n") * seconds).cast("double").alias("start"), F.least(F.col("duration"), ((F.col("n") + 1) * seconds)).cast("double").alias("end"))


def legacy_font(text: Column) -> Column:
    """Whether a text is of glyph codes of an 8-bit Indic font: over 50 characters, none of
    them Telugu, and over 15 percent in the upper half of Latin-1."""
    n = F.length(text)
    return (n >= 50) & (S.count_chars(text, "ఀ-౿") == 0) & (S.count_chars(text, "\u0080-\u00ff") > 0.15 * n)


def checked(extracted: DataFrame) -> DataFrame:
    """Extracted files whose text is in a legacy font come back with an error and no segments."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    bad = (F.col("source_type") == "press_release") & legacy_font(text)
    none = F.array().cast(extracted.schema["segments"].dataType)
    return extracted.withColumn("_bad", bad).select("source_file", "source_type", F.when(F.col("_bad"), none).otherwise(F.col("segments")).alias("segments"), F.when(F.col("_bad"), "legacy font without a glyph mapping").otherwise(F.col("error")).alias("error"))


def cleaned_or_raw(raw: Column, cleaned: Column) -> Column:
    """A model's clean-up of a text, kept only if it is at least half as long."""
    return F.when(F.length(cleaned) >= 0.5 * F.length(raw), F.trim(cleaned)).otherwise(raw)


def text_files(names: Column) -> Column:
    """Of an array of file names those with text, else their JSON sidecars."""
    named = lambda *ends: F.filter(names, lambda n: F.lower(n).rlike(rf"\.(?:{'|'.join(ends)})$"))
    return F.when(F.size(named("md", "txt", "html")) > 0, F.array_sort(named("md", "txt", "html"))).otherwise(F.array_sort(named("json")))


def extract(files: DataFrame, root: str, readers: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] | None = None) -> DataFrame:
    """(source_file, source_type, segments, error): every file read by the reader of its
    extension; a failure or a missing reader is an error in its row, never of the job."""
    own = READERS | (readers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, content in zip(f.path, f.source_type, f.content):
                rel = path.split(root.rstrip("/") + "/", 1)[-1]
                ext = rel.rsplit(".", 1)[-1].lower()
                mark = {"slide": "s", "table": "sheet"}.get(kind, "p")
                try:
                    if ext not in own:
                        raise LookupError(f"no reader for .{ext}")
                    parts = [(n, t) for n, t in own[ext](content) if t.strip()]
                    if not parts:
                        raise ValueError("no text")
                    segments = [_segment(rel, mark, n, t, k) for k, (n, t) in enumerate(parts, 1)]
                    rows.append((rel, kind, segments, None))
                except Exception as e:
                    rows.append((rel, kind, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "source_type", "segments", "error"])

    return files.select("path", "source_type", "content").mapInPandas(run, EXTRACTED)


def split_pages(text: Column) -> Column:
    """Pages of a text: at form feeds, else at lines of dashes."""
    by_feed = F.split(text, "\f")
    return F.transform(F.when(F.size(by_feed) > 1, by_feed).otherwise(F.split(text, r"(?m)^---+[ \t]*$")), lambda p: F.trim(p))


def repaired(segments: DataFrame) -> DataFrame:
    """(segment_id, page, text, language): data URIs dropped, pages numbered again, pages of
    under twelve characters left out, language detected anew. Doing it twice changes nothing."""
    pages = segments.select("segment_id", F.posexplode(split_pages(S.strip_data_uris(F.col("text_original")))).alias("i", "text"))
    return pages.where(F.length("text") >= PAGE_CHARS).select("segment_id", (F.col("i") + 1).alias("page"), "text", S.detect_language(F.col("text")).alias("language"))


def batch_page(batch: Column, page: Column, size: int = 10) -> Column:
    """Page of a document of a page inside one of its slices."""
    return batch * size + page


def artifacts(spark: SparkSession, folder: str, schema: str = ARTIFACT) -> DataFrame:
    """JSON artifacts of a folder; what does not parse is left out."""
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(folder)
    return rows.where("_corrupt is null").drop("_corrupt")


def corrupt_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n): the files of a folder with artifacts that do not parse, and how many."""
    rows = spark.read.schema(ARTIFACT + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(folder)
    return rows.select(F.input_file_name().alias("path"), "_corrupt").where("_corrupt is not null").groupBy("path").agg(F.count("*").alias("n"))


def question_set(text: str) -> list[dict]:
    """The questions of a YAML file, checked: ids there and unique, no question empty."""
    import yaml

    raw = yaml.safe_load(text) or {}
    rows = raw.get("questions", raw) if isinstance(raw, dict) else raw
    out, seen = [], set()
    for q in rows or []:
        key = str(q.get("id") or "").strip()
        if not key or key in seen or not str(q.get("q") or "").strip():
            raise ValueError(f"question without an id, with a repeated one or without words: {key!r}")
        seen.add(key)
        out.append({"id": key, "q": str(q["q"]).strip(), "lang": q.get("lang", "en"), "kind": q.get("kind", "single"), "meets": [str(m) for m in q.get("meets") or []], "entities": [str(e) for e in q.get("entities") or []]})
    if not out:
        raise ValueError("no questions")
    return out


def ontology(text: str) -> tuple[list[str], dict[str, tuple[list[str], list[str]]], dict[str, list[str]]]:
    """(node types, relations, aliases) of an ontology in YAML."""
    import yaml

    raw: dict[str, Any] = yaml.safe_load(text) or {}
    many = lambda x: x if isinstance(x, list) else [x]
    relations = {r: (many(d["from"]), many(d["to"])) for r, d in (raw.get("relationship_types") or {}).items()}
    return list(raw.get("node_types") or {}), relations, raw.get("aliases") or {}


def undeclared(types: list[str], relations: dict[str, tuple[list[str], list[str]]]) -> list[str]:
    """Ends of relations that are no declared type."""
    return sorted({t for a, b in relations.values() for t in [*a, *b]} - set(types))


def save_artifacts(rows: DataFrame, folder: str, by: str = "source_file") -> None:
    """One folder of JSON lines per source, replaced as a whole where it is written again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(folder)


def to_json(rows: DataFrame, path: str) -> None:
    with open(path, "w") as f:
        json.dump([r.asDict(True) for r in rows.collect()], f, ensure_ascii=False, indent=1, default=str)
