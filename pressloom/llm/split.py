"""Problem 2: oversized texts into overlapping pieces at natural boundaries.

One regular expression does the cutting: its alternatives, ordered by the strength of the
boundary they end at, each consume as much as the limit allows. Array functions turn the
pieces into offsets and step back from each cut to make the overlap. Nothing is shuffled;
every row is cut where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions.text import strip
from pressloom.sources.tables import table

LIMIT, OVERLAP = 4000, 400
#: How far a piece's start may move, so as not to begin inside a word.
SNAP = 40
_CLOSERS = r"[\"”’'»)\]」』]{0,2}"
_SHORT = r"(?<!\b(?:Rs|Dr|Mr|Smt|Sri|No|Sec|Ms|est|vs|p|vol|Approx|Dept|Corpn|[A-Z])\.\s)"


def pattern(limit: int, overlap: int) -> str:
    """The bounded-quantifier pattern for pieces that advance by at most limit - overlap."""
    most = limit - overlap
    least = max(1, most // 2)
    span = f".{{{least},{most}}}"
    return (
        r"(?s)\G(?:"
        + "|".join(
            [
                rf".{{1,{most}}}\z",
                rf"{span}(?<=\n[ \t]{{0,8}}\n|\f)(?!\n)",
                rf"{span}(?<=\n)",
                rf"{span}(?:(?<=[.!?।॥۔؟…]{_CLOSERS}\s){_SHORT}|(?<=[。！？]{_CLOSERS})(?![”’」』]))",
                rf"{span}(?<=[,;:،؛]\s|[，；：、])",
                rf"{span}(?<=\s)(?!\s)",
                rf"{span}(?![\p{{M}}‌‍])",
                rf".{{1,{most}}}",
            ]
        )
        + ")"
    )


def split_oversized(
    df: DataFrame, item_id: str, text: str, page: str | Column | None = None, limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces (item_id, piece, n_pieces, start, end, text, page) of every text.

    start and end are offsets in the text as stripped of white space at both ends; the text
    between them is the piece. Pieces have at most ``limit`` characters and each starts
    ``overlap`` characters before the end of the one before, less only where that would be
    inside a word that begins within SNAP characters.

    Null, empty and blank texts give no row. A text within the limit is one piece. Repeated
    rows are cut each on their own. A null id or page is kept as null. Other columns of df
    are not read, so their names cannot clash.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    where = F.lit(None).cast("int") if page is None else (F.col(page) if isinstance(page, str) else page).cast("int")
    base = df.select(F.col(item_id).alias("item_id"), strip(F.col(text)).alias("_t"), where.alias("page"))
    base = base.where(F.length("_t") > 0)
    cut = F.when(F.length("_t") <= limit, F.array("_t")).otherwise(
        F.regexp_extract_all("_t", F.lit(pattern(limit, overlap)), F.lit(0))
    )
    # ends[k] is where piece k ends; 0 stands before the first.
    ends = F.aggregate(
        F.transform("_cut", lambda p: F.length(p)),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    pieces = base.withColumn("_cut", cut).withColumn("_ends", ends).select(
        "item_id", "page", "_t", "_ends", (F.size("_ends") - 1).alias("n_pieces"), F.posexplode(F.slice("_ends", 2, F.size("_ends") - 1)).alias("piece", "end")
    )
    before = F.element_at("_ends", F.col("piece") + 1)
    back = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.greatest(before - overlap, F.lit(0)))
    window = F.substring("_t", F.col("_back") + 1, F.least(F.lit(SNAP), before - F.col("_back")))
    step = F.when(
        (F.col("piece") > 0) & (F.col("_back") > 0) & F.substring("_t", F.col("_back"), F.lit(1)).rlike(r"\S"),
        F.greatest(F.length(F.regexp_extract(window, r"^\S*\s+", 0)), F.length(F.regexp_extract(window, r"^[\p{M}‌‍]+", 0))),
    ).otherwise(0)
    return (
        pieces.withColumn("_back", back)
        .withColumn("start", F.col("_back") + step)
        .select("item_id", "piece", "n_pieces", "start", "end", F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "page")
    )


def pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of every oversized segment and chunk."""
    seg = split_oversized(table(spark, sf_dir, "segments", "segment_id", "text_original", "locator"), "segment_id", "text_original", F.col("locator.page"))
    chk = split_oversized(table(spark, sf_dir, "chunks", "chunk_id", "text", "page"), "chunk_id", "text", "page")
    both = seg.withColumn("item_kind", F.lit("segment")).unionByName(chk.withColumn("item_kind", F.lit("chunk")))
    return both.where("n_pieces > 1").select("item_kind", "item_id", "piece", "n_pieces", "start", "end", "text", "page")


def found(spark, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).select("item_kind", "item_id").distinct()
