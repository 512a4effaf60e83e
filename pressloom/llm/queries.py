"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import SPACE, SPACE_RE2
from pressloom.llm import language, leak, mojibake, names, neardup, packing, residue, scans, sentences, split
from pressloom.sources.tables import table


def pieces_kept(spark, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every oversized text: none over the limit, each where
    the one before ends or up to the overlap before, together the whole text."""
    w = Window.partitionBy("item_kind", "item_id", "n_pieces").orderBy("piece")
    p = split.pieces(spark, sf_dir).distinct()
    step = p.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    good = (F.length("text") <= split.LIMIT) & (F.col("start") <= F.col("before")) & (F.col("before") - F.col("start") <= split.OVERLAP) & (F.col("end") - F.col("start") == F.length("text"))
    return step.groupBy("item_kind", "item_id").agg(F.bool_and(good).alias("kept"), F.max("end").alias("size"))


def units_cover(spark, sf_dir: str) -> DataFrame:
    """Characters of every chunk that stand in sentence units, white space left out."""
    once = table(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").distinct()
    unit = sentences.found(spark, sf_dir).join(once, "chunk_id")
    bare = F.length(F.regexp_replace(F.substring("text", F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start")), f"{SPACE}+", ""))
    return unit.groupBy("chunk_id").agg(F.sum(bare).alias("n"))


def copies_share_classes(spark, sf_dir: str) -> DataFrame:
    """Every chunk with a word has a class, and chunks of one text have one and the same."""
    member = neardup.links(table(spark, sf_dir, "chunks", "chunk_id", "text"), "chunk_id", "text")[0].select("item_id", "class_id").distinct()
    once = table(spark, sf_dir, "chunks", "chunk_id", "text").distinct().withColumn("t", F.md5("text"))
    return once.join(member, F.col("chunk_id") == F.col("item_id")).groupBy("t").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("class_id").alias("n_classes"))


def packing_kept(spark, sf_dir: str) -> DataFrame:
    """Every document lies whole in containers, and none is over its capacity."""
    p = packing.containers(spark, sf_dir)
    over = p.groupBy("container_id").agg(F.sum("n_tokens").alias("load")).where(F.col("load") > packing.CAPACITY)
    doc = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    hit = p.join(over, "container_id", "left_semi").select("doc_id").distinct().withColumn("over", F.lit(True))
    kept = (F.col("tokens") == F.col("end")) & (F.col("pieces") == F.ceil(F.col("tokens") / packing.CAPACITY)) & F.col("over").isNull()
    return doc.join(hit, "doc_id", "left").select("doc_id", kept.alias("kept"))


def queries() -> dict:
    return {
        "p1_found": names.found,
        "p1_groups": names.groups,
        "p2_found": split.found,
        "p2_pieces": split.pieces,
        "p10_found": residue.found,
        "p10_reasons": residue.reasons,
        "p3_found": sentences.found,
        "p3_segments": sentences.segment_units,
        "p4_found": scans.found,
        "p4_repaired": scans.report,
        "p5_found": mojibake.found,
        "p5_restored": mojibake.report,
        "p6_found": neardup.found,
        "p6_linked": neardup.linked,
        "p7_found": language.found,
        "p7_parts": language.parts,
        "p8_packed": packing.containers,
        "p8_loads": packing.loads,
        "p9_found": leak.found,
        "p9_items": leak.items_leaked,
        "p2_kept": pieces_kept,
        "p3_cover": units_cover,
        "p6_copies": copies_share_classes,
        "p8_kept": packing_kept,
    }


def _size(kind: str, key: str, column: str, name: str) -> str:
    trimmed = f"regexp_replace(regexp_replace({column}, '^{SPACE_RE2}+', ''), '{SPACE_RE2}+$', '')"
    return f"SELECT '{kind}' AS item_kind, {key} AS item_id, true AS kept, max(length({trimmed}))::INT AS size FROM {name} WHERE length({trimmed}) > 4000 GROUP BY 2"


def _long(kind: str, key: str, column: str, name: str) -> str:
    trimmed = f"regexp_replace(regexp_replace({column}, '^{SPACE_RE2}+', ''), '{SPACE_RE2}+$', '')"
    return f"SELECT '{kind}' AS item_kind, {key} AS item_id FROM {name} WHERE length({trimmed}) > 4000"


_WORDS = f"list_filter(string_split_regex({{}}, '{SPACE_RE2}+'), lambda x: x <> '')"
_LETTERS = rf"regexp_replace(lower({{}}), '[^\p{{{{L}}}}\p{{{{M}}}}\p{{{{N}}}}{SPACE_RE2[1:-1].replace('{', '{{').replace('}', '}}')}]+', '', 'g')"


def _grams(key: str, words: str, name: str, n: int) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {name}))"


def oracle_sql() -> dict:
    plain = lambda c: _WORDS.replace("{}", _LETTERS.format(c))
    return {
        "p2_kept": f"{_size('segment', 'segment_id', 'text_original', 'segments')} UNION ALL {_size('chunk', 'chunk_id', 'text', 'chunks')}",
        "p3_cover": f"SELECT chunk_id, length(regexp_replace(text, '{SPACE_RE2}+', '', 'g'))::BIGINT AS n FROM (SELECT DISTINCT chunk_id, text FROM chunks) WHERE length(regexp_replace(text, '{SPACE_RE2}+', '', 'g')) > 0",
        "p6_copies": f"SELECT md5(text) AS t, count(DISTINCT chunk_id) AS n_chunks, 1::BIGINT AS n_classes FROM chunks WHERE regexp_replace(text, '{SPACE_RE2}+', '', 'g') <> '' GROUP BY 1",
        "p8_kept": "SELECT DISTINCT doc_id, true AS kept FROM documents WHERE text <> ''",
        "p2_found": f"SELECT DISTINCT * FROM ({_long('segment', 'segment_id', 'text_original', 'segments')} UNION ALL {_long('chunk', 'chunk_id', 'text', 'chunks')})",
        "p6_found": f"WITH s AS ({_grams('chunk_id', _WORDS.replace('{}', 'lower(text)'), 'chunks', 3)}), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2) SELECT x AS chunk_id_a, y AS chunk_id_b FROM o JOIN n p ON x = p.chunk_id JOIN n q ON y = q.chunk_id WHERE o >= 0.6 * (p.n + q.n - o)",
        "p9_found": f"WITH d AS ({_grams('doc_id', plain('text'), 'documents', 12)}), e AS ({_grams('item_id', plain('passage'), 'eval_items', 12)}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    }
