"""Extracted entities and relations: cutting texts for a model, checking what it returns,
merging, and resolving names by exact rules. Models themselves are a seam."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.functions.text import content_hash, strip
from pressloom.operators.components import connected_components

LIMIT, QUOTE = 2400, 400
RECORD = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,relation:string,target:string,evidence:string>>"


def pieces(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, piece_id, text, content_hash): texts over the limit cut before the last line
    break, else before the last space, of the second half of their room; each piece with an
    id and a hash of its own. Null and blank texts give no piece."""
    half = limit // 2
    room = rf"(?s)\G(?:.{{1,{limit}}}\z|.{{{half},{limit - 1}}}(?=\n)|.{{{half},{limit - 1}}}(?= )|.{{{limit}}})"
    cut = F.filter(F.transform(F.regexp_extract_all("text", F.lit(room), F.lit(0)), strip), lambda p: p != "")
    flat = chunks.select("chunk_id", F.length("text").alias("size"), F.posexplode(cut).alias("i", "text"))
    piece = F.when(F.col("size") > limit, F.concat("chunk_id", F.lit("#s"), F.col("i").cast("string"))).otherwise(F.col("chunk_id"))
    return flat.select("chunk_id", piece.alias("piece_id"), "text", content_hash(F.col("text")).alias("content_hash"))


def outstanding(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Pieces whose content no cached record holds."""
    return wanted.join(cache.select("content_hash").distinct(), "content_hash", "left_anti")


def with_records(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached record of their content; a content without hash goes by its id."""
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("chunk_id"))
    return chunks.withColumn("content_hash", key).join(cache, "content_hash")


def plan_report(selected: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: what extracting chosen chunks (chunk_id, text, content_hash, skip) would cost."""
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("chunk_id"))
    rows = selected.withColumn("_k", key).join(cache.select(F.col("content_hash").alias("_k")).distinct().withColumn("_c", F.lit(True)), "_k", "left")
    picked = F.col("skip").isNull()
    due = picked & F.col("_c").isNull()
    chars, calls = F.coalesce(F.sum(F.when(due, F.length("text"))), F.lit(0)), F.count_if(due)
    return rows.agg(F.count("*").alias("chunks"), F.count_if(picked).alias("selected"), F.count_if(picked & F.col("_c")).alias("cached"), calls.alias("calls"), chars.alias("chars"), (F.floor(chars / 3) + calls * 700).alias("input_tokens"), (calls * 400).alias("output_tokens"))


def persistent(call: Callable[[str], dict], attempts: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """A call tried again after failures that may pass, each wait twice the one before and a
    little more; a client error (but 408 and 429) is final."""

    def run(text: str) -> dict:
        for k in range(attempts):
            try:
                return call(text)
            except Exception as e:
                status = getattr(e, "status", None)
                if k + 1 == attempts or (status is not None and 400 <= status < 500 and status not in (408, 429)):
                    raise
                sleep(wait * 2**k * (1 + 0.1 * random.random()))
        raise AssertionError("unreachable")

    return run


def halving(call: Callable[[str], dict | None], least: int = 800) -> Callable[[str], dict]:
    """A call that is made for both halves of a text where it comes back empty for the whole;
    their records are put together. Raises where nothing comes back."""

    def run(text: str) -> dict:
        found = call(text)
        if found is None and len(text) >= least:
            middle = len(text) // 2
            left, right = text.rfind(" ", 0, middle), text.find(" ", middle)
            at = min((x for x in (left, right) if x > 0), key=lambda x: abs(x - middle), default=middle)
            parts = [r for r in (call(text[:at].strip()), call(text[at:].strip())) if r is not None]
            found = {k: [x for r in parts for x in r.get(k) or []] for k in ("entities", "relations")} if parts else None
        if found is None:
            raise ValueError("no record")
        return found

    return run


def run_model(wanted: DataFrame, make: Callable[[], Callable[[str], dict]], slices: int) -> DataFrame:
    """(content_hash, entities, relations, error): a model over distinct contents; ``make`` is
    called once in each task, and a failure stays in its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            rows = []
            for h, t in zip(f.content_hash, f.text):
                try:
                    r = model(t)
                    rows.append((h, r.get("entities") or [], r.get("relations") or [], None))
                except Exception as e:
                    rows.append((h, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content_hash", "entities", "relations", "error"])

    once = wanted.dropDuplicates(["content_hash"]).select("content_hash", "text").repartition(slices)
    return once.mapInPandas(run, f"content_hash string, {RECORD}, error string")


def entities(records: DataFrame, types: list[str]) -> DataFrame:
    """(content_hash, name, type, key, issue): named entities, each (type, key) once for a
    content, first one kept; issue marks those without a name or with an undeclared type."""
    flat = records.select("content_hash", F.posexplode("entities").alias("pos", "e")).select("content_hash", "pos", F.trim("e.name").alias("name"), "e.type", S.normalise(F.col("e.name")).alias("key"))
    issue = F.when(F.coalesce(F.col("key"), F.lit("")) == "", "unnamed").when(F.col("type").isNull(), "untyped").when(~F.col("type").isin(*types), "unknown_type")
    w = Window.partitionBy("content_hash", "type", "key").orderBy("pos")
    return flat.withColumn("issue", issue).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "pos")


def relations(records: DataFrame, known: DataFrame, triples: DataFrame) -> DataFrame:
    """(content_hash, source_id, relation, target_id, evidence, issue): relations whose ends
    are entities of their content, checked against the ontology's triples; first one kept."""
    good = known.where("issue is null")
    first = good.groupBy("content_hash", "key").agg(F.min("type").alias("type"))
    flat = records.select("content_hash", F.posexplode("relations").alias("pos", "r")).select(
        "content_hash", "pos", "r.relation", F.substring("r.evidence", 1, QUOTE).alias("evidence"), S.normalise(F.col("r.source")).alias("a"), S.normalise(F.col("r.target")).alias("b")
    )
    ends = lambda k, t: first.select("content_hash", F.col("key").alias(k), F.col("type").alias(t))
    typed = flat.join(ends("a", "source_type"), ["content_hash", "a"], "left").join(ends("b", "target_type"), ["content_hash", "b"], "left")
    legal = typed.join(F.broadcast(triples.withColumn("legal", F.lit(True))), ["relation", "source_type", "target_type"], "left")  # the ontology is declared
    issue = F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "unresolved_end").when(F.col("legal").isNull(), "illegal_triple")
    named = legal.select("content_hash", F.concat_ws(":", "source_type", "a").alias("source_id"), "relation", F.concat_ws(":", "target_type", "b").alias("target_id"), "evidence", issue.alias("issue"), "pos")
    w = Window.partitionBy("content_hash", "source_id", "relation", "target_id").orderBy("pos")
    return named.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "pos")


def resolve(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(entity_id, resolved_id, display): rows of one type that share a normalised name, or an
    alias of the ontology (surface, canonical), become one. Nothing is matched by likeness.

    The display name is the ontology's where a member has one; else the most frequent Latin
    name, the shorter on a tie; else the most frequent."""
    base = nodes.select("entity_id", "type", "name", "mention_count", S.normalise(F.col("name")).alias("key")).where("key <> ''")
    if aliases is not None:
        known = aliases.select(S.normalise(F.col("surface")).alias("key"), "canonical").groupBy("key").agg(F.min("canonical").alias("canonical"))
        base = base.join(known, "key", "left")
    else:
        base = base.withColumn("canonical", F.lit(None).cast("string"))
    base = base.withColumn("ckey", S.normalise(F.coalesce("canonical", "name")))
    own = base.select(F.col("entity_id").alias("src"), F.concat_ws("\x1f", "type", "key").alias("dst"))
    alias = base.where("canonical is not null").select(F.col("entity_id").alias("src"), F.concat_ws("\x1f", "type", "ckey").alias("dst"))
    comp = connected_components(own.unionByName(alias)).select(F.col("node").alias("entity_id"), F.col("component").alias("resolved_id"))
    member = base.join(comp, "entity_id")
    names = member.groupBy("resolved_id", "name").agg(F.sum("mention_count").alias("n"))
    best = names.groupBy("resolved_id").agg(F.min_by("name", F.struct(~S.is_latin(F.col("name")), -F.col("n"), F.length("name"), "name")).alias("best"))
    given = member.groupBy("resolved_id").agg(F.min("canonical").alias("given"))
    return member.select("entity_id", "resolved_id").join(best, "resolved_id").join(given, "resolved_id").select("entity_id", "resolved_id", F.coalesce("given", "best").alias("display"))


class HashEmbedder:
    """Deterministic vectors without a model: words hashed by md5 into signed buckets, as
    counts; whoever compares them brings them to unit length."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension
        self.word = re.compile(r"[\w\u0C00-\u0C7F\u0900-\u097F]+")
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> list[float]:
        return self.of_words(self.word.findall((text or "").lower()))

    def of_words(self, words: list[str]) -> list[float]:
        v = [0.0] * self.dimension
        for w in words:
            if (at := self.known.get(w)) is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                h = hashlib.md5(w.encode()).hexdigest()
                at = self.known[w] = (int(h[:2], 16) % self.dimension, 1 if h[2] < "8" else -1)
            v[at[0]] += at[1]
        return v


def embed(rows: DataFrame, item_id: str, text: str, make: Callable[[], Callable[[str], list[float]]] = HashEmbedder) -> DataFrame:
    """(item_id, vector) by an embedder made once in each task; the default one gets the words
    of the lexical index. Null texts and those it finds nothing in have no row."""
    kind = rows.schema[item_id].dataType.simpleString()
    plain = make is HashEmbedder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        one = model.of_words if plain else model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], [item_id, "vector"])

    given = S.words(F.col(text)) if plain else F.col(text)
    made = rows.where(F.col(text).isNotNull()).select(item_id, given.alias("_given")).mapInArrow(run, f"{item_id} {kind}, vector array<float>")
    return made.where(F.exists("vector", lambda x: x != 0))


def extractive(question: str, sources: list[tuple[int, str]], most: int = 3) -> str:
    """An answer without a model: the sentences of the sources that share most words with the
    question, each with its citation."""
    asked = set(re.findall(r"\w{3,}", question.lower()))
    ranked = sorted(((-len(asked & set(re.findall(r"\w{3,}", s.lower()))), n, i, s.strip()) for n, t in sources for i, s in enumerate(re.split(r"(?<=[.!?।])\s+", t)) if s.strip()), key=lambda x: x[:3])
    return " ".join(f"{s.rstrip('.!?। ')} [{n}]." for hits, n, _, s in ranked[:most] if hits)
