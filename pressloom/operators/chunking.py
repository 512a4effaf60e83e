"""Cutting documents into passages, and choosing passages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.functions.text import content_hash
from pressloom.operators.components import connected_components
from pressloom.session import spread

TARGET, OVERLAP = 1000, 120
#: Fixed: strength of a heading, a blank line and a sentence end.
BREAKS = ((re.compile(r"(?m)^#{1,6} "), 3, False), (re.compile(r"\n[ \t]*\n"), 2, True), (re.compile(r"[.?!।॥]+[\"')\]]*\s"), 1, True))


def split_chars(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Offsets of overlapping passages that end at the strongest break in the second half of
    their room, the one nearest its end among equals."""
    indic = sum(1 for c in text[:2000] if "ऀ" <= c <= "ൿ")
    per_token = 4.0 if indic > 0.2 * max(1, len(text[:2000])) else 5.0
    room, back = int(target * per_token), int(overlap * per_token)
    if len(text) <= room:
        return [(0, len(text))]
    marks = sorted((m.end() if after else m.start(), strength) for pattern, strength, after in BREAKS for m in pattern.finditer(text))
    out, start, k = [], 0, 0
    while True:
        end = min(start + room, len(text))
        if end == len(text):
            out.append((start, end))
            return out
        while k < len(marks) and marks[k][0] < start + room // 2:
            k += 1
        best, j = (0, 0), k
        while j < len(marks) and marks[j][0] <= end:
            if (marks[j][1], marks[j][0]) > best:
                best = (marks[j][1], marks[j][0])
            j += 1
        if best[1] > start:
            end = best[1]
        out.append((start, end))
        start = max(end - back, start + 1)
        while k and marks[k - 1][0] >= start + room // 2:
            k -= 1


CEILING, TAIL = 1400, 80


def split_tokens(text: str, offsets: list[tuple[int, int]], target: int = TARGET, overlap: int = OVERLAP, ceiling: int = CEILING) -> list[str]:
    """Passages of a stripped text with the spans of its tokens, none of more than ``ceiling``
    tokens: each ends at the strongest break near the target, or else further around it, and
    the next begins at a break near the overlap. A tail of few tokens joins what is before."""
    n = len(offsets)
    if n <= ceiling:
        return [text] if text else []
    starts = [a for a, _ in offsets]
    breaks: dict[int, int] = {}  # token that begins behind a break -> its strength
    for pattern, strength, after in BREAKS:
        for m in pattern.finditer(text):
            token = bisect_left(starts, m.end() if after else m.start())
            breaks[token] = max(strength, breaks.get(token, 0))
    order = sorted(breaks)

    def best(low: int, high: int, want: int) -> int | None:
        inside = order[bisect_left(order, low) : bisect_right(order, min(high, n - 1))]
        return max(inside, key=lambda t: (breaks[t], -abs(t - want)), default=None)

    def stop(at: int) -> int:
        want = at + target
        windows = ((at + target * 3 // 5, at + target * 5 // 4), (at + target // 2, at + ceiling))
        return n if want >= n else next((t for w in windows if (t := best(*w, want)) is not None), want)

    def resume(at: int, end: int) -> int:
        back = max(end - overlap, at + 1)
        return best(max(back - overlap // 2, at + 1), back, back) or back

    spans = [(0, stop(0))]
    while spans[-1][1] < n:
        at = resume(*spans[-1])
        spans.append((at, stop(at)))
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < TAIL and spans[-1][1] - spans[-2][0] <= ceiling:
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    return [p for p in (text[offsets[a][0] : offsets[z - 1][1]].strip() for a, z in spans) if p]


def token_passages(df: DataFrame, item_id: str, text: str, offsets_of: Callable[[], Callable[[str], list[tuple[int, int]]]], target: int = TARGET, overlap: int = OVERLAP, ceiling: int = CEILING) -> DataFrame:
    """(item_id, idx, text): passages measured by a tokenizer, which ``offsets_of`` makes once
    in each task: text -> spans of its tokens in characters."""
    kind = df.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = offsets_of()
        for b in batches:
            at, order, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t.strip()
                own = split_tokens(t, spans(t), target, overlap, ceiling) if t else []
                at += [i] * len(own)
                order += range(len(own))
                out += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array(out, pa.string())], ["item_id", "idx", "text"])

    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    return spread(rows).mapInArrow(run, f"item_id {kind}, idx int, text string")


def passages(df: DataFrame, item_id: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, idx, text): passages of every text that is not blank, stripped."""
    kind = df.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, order, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t.strip()
                pieces = [x for x in (t[a:z].strip() for a, z in split_chars(t, target, overlap)) if x] if t else []
                at += [i] * len(pieces)
                order += range(len(pieces))
                out += pieces
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(order, pa.int32()), pa.array(out, pa.string())], ["item_id", "idx", "text"])

    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    return spread(rows).mapInArrow(run, f"item_id {kind}, idx int, text string")


def segment_passages(segments: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Passages of segments with all they carry: id, text, hash, language and citation."""
    once = segments.dropDuplicates(["segment_id"])
    cut = passages(once, "segment_id", "text_original", target, overlap).withColumnRenamed("item_id", "segment_id")
    loc = F.col("locator")
    meta = once.select(
        "segment_id", "source_file", "source_type", "press_meet_id", "press_meet_title", "date", "topic", "publication", "speaker",
        loc["page"].alias("page"), loc["slide"].alias("slide"), loc["video_span"]["start"].alias("video_start"), loc["video_span"]["end"].alias("video_end"),
    )
    full = cut.join(meta, "segment_id")
    return full.select(
        F.concat("segment_id", F.lit("#c"), F.col("idx").cast("string")).alias("chunk_id"),
        "*",
        content_hash(F.col("text")).alias("content_hash"),
        S.detect_language(F.col("text")).alias("language"),
        S.citation_label(F.col("source_file"), F.col("publication"), F.col("page"), F.col("slide"), F.col("video_start"), F.col("date")).alias("citation"),
    )


def merge_spans(segments: DataFrame, target: int = TARGET) -> DataFrame:
    """(source_file, bucket, first_id, n, start, end, text): consecutive timed segments of a
    file fused until the next one would pass the target, in one fold over sorted arrays."""
    once = segments.where("locator.video_span is not null").dropDuplicates(["segment_id"])
    item = F.struct(F.col("locator.video_span.start").alias("start"), "segment_id", F.col("locator.video_span.end").alias("end"), F.trim("text_original").alias("text"), S.token_estimate(F.col("text_original")).alias("tokens"))
    rows = once.groupBy("source_file").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(-1).alias("bucket"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["bucket"] < 0) | (acc["run"] + x["tokens"] > target)
        bucket = F.when(fresh, acc["bucket"] + 1).otherwise(acc["bucket"])
        return F.struct(bucket.alias("bucket"), F.when(fresh, x["tokens"]).otherwise(acc["run"] + x["tokens"]).alias("run"), F.concat(acc["of"], F.array(bucket)).alias("of"))

    placed = rows.withColumn("of", F.aggregate("items", zero, step, lambda acc: acc["of"]))
    flat = placed.select("source_file", F.posexplode(F.arrays_zip("items", "of")).alias("pos", "z")).select("source_file", "pos", "z.items.*", F.col("z.of").alias("bucket"))
    return flat.groupBy("source_file", "bucket").agg(
        F.min_by("segment_id", "pos").alias("first_id"), F.count("*").alias("n"), F.min("start").alias("start"), F.max_by("end", "pos").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("text"),
    )


MIN_CHARS, MAX_TAGS, FILE_CAP, MAX_CHARS = 150, 0.5, 60, 2400


def eligible(chunks: DataFrame, wanted: list[str] | None = None, min_chars: int = MIN_CHARS, max_tags: float = MAX_TAGS) -> DataFrame:
    """Chunks with the first rule they fail as ``skip``, null for those that pass."""
    rules = F.when(~F.col("source_type").isin(*wanted) if wanted else F.lit(False), "source_type").when(F.length("text") < min_chars, "short").when(S.tag_density(F.col("text")) >= max_tags, "markup")
    return chunks.withColumn("skip", rules)


def select_chunks(chunks: DataFrame, cap: int = FILE_CAP, **rules) -> DataFrame:
    """(chunk_id, skip): the whole cost gate. A content is seen only once it is kept and a
    duplicate takes no room of its file, so cap and duplicates depend on one another. Where
    a file stays within its cap whatever happens, order does not matter and a window decides;
    only files that could pass the cap, and what shares a content with them, are gone through
    in order, over ids and hashes alone. Files that share no content, not even by way of
    others, have nothing to do with each other: each such group is a walk of its own."""
    key = F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), F.col("chunk_id"))
    graded = eligible(chunks.dropDuplicates(["chunk_id"]), **rules).withColumn("_key", key)
    passed = graded.where("skip is null").select("chunk_id", "source_file", "_key")
    failed = graded.where("skip is not null").select("chunk_id", "skip")
    first = Window.partitionBy("_key").orderBy("source_file", "chunk_id")
    plain = passed.withColumn("_n", F.row_number().over(first))
    if cap <= 0:
        return plain.select("chunk_id", F.when(F.col("_n") > 1, "duplicate").alias("skip")).unionByName(failed)
    full = passed.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("source_file", F.lit(True).alias("limited"))
    # contents that occur in a file that may pass its cap; the others never meet the cap
    tangled = passed.join(full, "source_file", "left_semi").select("_key").distinct()
    simple = plain.join(tangled, "_key", "left_anti").select("chunk_id", F.when(F.col("_n") > 1, "duplicate").alias("skip"))
    marked = passed.join(tangled, "_key", "left_semi").join(full, "source_file", "left").select("chunk_id", "source_file", "_key", F.coalesce("limited", F.lit(False)).alias("limited"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        kept: dict = {}
        now = None
        for b in batches:
            ids, skip = [], []
            for c, f, k, limited, group in zip(*(b.column(i).to_pylist() for i in range(5))):
                if group != now:
                    now, seen, kept = group, set(), {}
                ids.append(c)
                if limited and kept.get(f, 0) >= cap:
                    skip.append("over_file_cap")
                elif k in seen:
                    skip.append("duplicate")
                else:
                    seen.add(k)
                    kept[f] = kept.get(f, 0) + 1
                    skip.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(skip, pa.string())], ["chunk_id", "skip"])

    links = marked.select(F.concat(F.lit("f"), "source_file").alias("src"), F.concat(F.lit("k"), "_key").alias("dst")).distinct()
    group = connected_components(links).where("node like 'f%'").select(F.expr("substring(node, 2)").alias("source_file"), "component")
    walks = marked.join(group, "source_file").select("chunk_id", "source_file", "_key", "limited", "component").repartition("component").sortWithinPartitions("component", "source_file", "chunk_id")
    walked = walks.mapInArrow(walk, "chunk_id string, skip string")
    return simple.unionByName(walked).unionByName(failed)


def halves(text: Column, least: int = 800, reach: int = 200) -> Column:
    """The two parts of a long text cut at the space nearest its middle, null for short ones."""
    mid = (F.length(text) / 2).cast("int")
    left = F.regexp_extract(F.substring(text, mid - reach + 1, F.lit(reach)), r"(?s) ([^ ]*)$", 1)
    right = F.regexp_extract(F.substring(text, mid + 1, F.lit(reach)), r"(?s)^([^ ]*) ", 1)
    has_left = F.substring(text, mid - reach + 1, F.lit(reach)).contains(" ")
    has_right = F.substring(text, mid + 1, F.lit(reach)).contains(" ")
    cut = F.when(has_left & (~has_right | (F.length(left) <= F.length(right))), mid - F.length(left)).when(has_right, mid + F.length(right)).otherwise(mid)
    return F.when(F.length(text) >= least, F.array(F.trim(F.substring(text, F.lit(1), cut)), F.trim(F.substring(text, cut + 1, F.length(text)))))


def ngrams(text: Column, most: int = 5) -> Column:
    """Spans (start, end, text) of up to ``most`` words of a normalised text, longest first.
    The text is a column of its own, as no Python function may stand inside a lambda."""
    ws = F.filter(F.split(text, " "), lambda w: w != "")
    sizes = F.sequence(F.lit(most), F.lit(1), F.lit(-1))
    spans = F.transform(
        sizes,
        lambda n: F.when(
            F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice(ws, i + 1, n), " ").alias("text")))
        ).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")),
    )
    return F.flatten(spans)
