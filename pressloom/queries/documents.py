"""Scans, filters, segmentation and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import scalars as S
from pressloom.functions.text import SPACE_RE2, content_hash
from pressloom.operators import chunking as D
from pressloom.operators.filters import Filters, glob
from pressloom.session import spread
from pressloom.sources import files as A
from pressloom.sources.tables import table


def source_types(spark, d) -> DataFrame:
    return table(spark, d, "chunks", "source_file").select(S.source_type(F.col("source_file")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def detect_language(spark, d) -> DataFrame:
    c = spread(table(spark, d, "chunks", "text", "language"))
    return c.groupBy(S.detect_language(F.col("text")).alias("detected"), "language").agg(F.count("*").alias("n"))


def content_hashes(spark, d) -> DataFrame:
    c = table(spark, d, "chunks", "text", "content_hash").select(content_hash(F.col("text")).alias("hash"), "content_hash")
    return c.groupBy("hash").agg(F.count("*").alias("copies"), F.count_if(F.col("hash") == F.col("content_hash")).alias("labelled")).where("copies > 1")


def filter_passages(spark, d) -> DataFrame:
    f = Filters(language="te", source_type="source_doc", since="2025-01-01", until="2025-12-31")
    return f.apply(table(spark, d, "chunks", "chunk_id", "language", "source_type", "date")).select("chunk_id", "date")


def filter_glob(spark, d) -> DataFrame:
    c = table(spark, d, "chunks", "source_file")
    return c.where(glob(F.col("source_file"), "annexures/set ?/*.pdf")).groupBy("source_file").agg(F.count("*").alias("n"))


def iso_dates(spark, d) -> DataFrame:
    m = table(spark, d, "chunks", "source_file").distinct()
    own = S.meet_of(F.col("source_file"))
    return m.select("source_file", own["press_meet_id"].alias("meet"), own["date"].alias("date"), own["topic"].alias("topic"))


def citations(spark, d) -> DataFrame:
    c = table(spark, d, "chunks", "chunk_id", "source_file", "publication", "page", "slide", "video_start", "date").distinct()
    return c.select("chunk_id", S.citation_label(F.col("source_file"), F.col("publication"), F.col("page"), F.col("slide"), F.col("video_start"), F.col("date")).alias("label"))


def tag_densities(spark, d) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.round(S.tag_density(F.col("text")), 6).alias("density")).where("density > 0")


def token_estimates(spark, d) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


def query_terms(spark, d) -> DataFrame:
    q = table(spark, d, "eval_items", "item_id", "q")
    return q.select("item_id", F.array_join(F.array_sort(S.query_terms(F.col("q"))), " ").alias("terms"))


def latin_texts(spark, d) -> DataFrame:
    return table(spark, d, "chunks", "text").groupBy(S.is_latin(F.col("text")).alias("latin")).agg(F.count("*").alias("n"))


def clipped(spark, d) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", S.clip(F.col("text"), 200).alias("clip"))


def term_overlap(spark, d) -> DataFrame:
    q = table(spark, d, "eval_items", "item_id", "q", "passage")
    return q.select("item_id", F.round(S.jaccard(S.query_terms(F.col("q")), S.query_terms(F.col("passage"))), 6).alias("jaccard"))


def normalised_names(spark, d) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "name").select("entity_id", S.normalise(F.col("name")).alias("name"))


def split_pages(spark, d) -> DataFrame:
    s = table(spark, d, "segments", "segment_id", "text_original").where("text_original is not null").distinct()
    return s.select("segment_id", F.posexplode(A.split_pages(F.col("text_original"))).alias("page", "text")).select("segment_id", "page", F.length("text").alias("n"))


def repaired_pages(spark, d) -> DataFrame:
    return A.repaired(table(spark, d, "segments", "segment_id", "text_original").where("text_original is not null").distinct()).select("segment_id", "page", "language", F.length("text").alias("n"))


def cleaned_ocr(spark, d) -> DataFrame:
    s = table(spark, d, "segments", "segment_id", "source_type", "text_original").where("source_type = 'news_clip'").distinct()
    return s.select("segment_id", S.clean_ocr(F.col("text_original")).alias("text"))


def passages_by_chars(spark, d) -> DataFrame:
    return D.passages(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select(F.col("item_id").alias("doc_id"), "idx", F.length("text").alias("n"))


def segment_passages(spark, d) -> DataFrame:
    return D.segment_passages(table(spark, d, "segments")).select("chunk_id", "content_hash", "language", "citation")


def merged_spans(spark, d) -> DataFrame:
    return D.merge_spans(table(spark, d, "segments")).drop("text")


def select_plain(spark, d) -> DataFrame:
    return D.select_chunks(table(spark, d, "chunks", "chunk_id", "text", "content_hash", "source_file", "source_type"), cap=0)


_WANTED = ["press_release", "news_clip", "video", "slide", "source_doc"]


def select_capped(spark, d) -> DataFrame:
    return D.select_chunks(table(spark, d, "chunks", "chunk_id", "text", "content_hash", "source_file", "source_type"), wanted=_WANTED)


def halved(spark, d) -> DataFrame:
    h = D.halves(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", h.alias("h")).where("h is not null").select("doc_id", F.length(F.col("h")[0]).alias("left"), F.length(F.col("h")[1]).alias("right"))


def question_ngrams(spark, d) -> DataFrame:
    n = table(spark, d, "eval_items", "item_id", "q").select("item_id", S.normalise(F.col("q")).alias("n"))
    return n.select("item_id", F.explode(D.ngrams(F.col("n"))).alias("s")).groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.length("s.text")).alias("longest"))


def dates_checked(spark, d) -> DataFrame:
    x = table(spark, d, "extracted_docs", "date")
    return x.groupBy(F.when(F.col("date").isNull(), "none").when(F.col("date").try_cast("date").isNull(), "impossible").otherwise("real").alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    "source_types": source_types, "detect_language": detect_language, "content_hash_copies": content_hashes, "filter_passages": filter_passages, "filter_glob": filter_glob, "meet_of_path": iso_dates, "citation_labels": citations,
    "tag_density": tag_densities, "token_estimate": token_estimates, "query_terms": query_terms, "latin_texts": latin_texts, "clip_texts": clipped, "jaccard_terms": term_overlap, "normalise_names": normalised_names, "split_pages": split_pages,
    "repaired_pages": repaired_pages, "clean_ocr": cleaned_ocr, "chunk_by_chars": passages_by_chars, "segment_passages": segment_passages, "merge_spans": merged_spans, "select_chunks": select_plain, "select_chunks_capped": select_capped, 
    "halve_texts": halved, "question_ngrams": question_ngrams, "dates_checked": dates_checked,
}

_count = lambda c, k: f"(length({c}) - length(regexp_replace({c}, '[{k}]', '', 'g')))"
_TE, _HI, _EN = (_count("text", k) for k in (r"\x{0C00}-\x{0C7F}", r"\x{0900}-\x{097F}", "A-Za-z"))
_LANG = "CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 'unknown' WHEN (n - greatest(te, hi, en) - least(te, hi, en)) / n >= 0.25 THEN 'mixed' WHEN greatest(te, hi, en) / n < 0.5 THEN 'mixed' WHEN te >= hi AND te >= en THEN 'te' WHEN hi >= en THEN 'hi' ELSE 'en' END"
_COUNTS = f"SELECT *, te + hi + en AS n FROM (SELECT *, {_TE}::DOUBLE AS te, {_HI}::DOUBLE AS hi, {_EN}::DOUBLE AS en FROM {{}})"
_SQUEEZE = rf"trim(regexp_replace({{}}, '{SPACE_RE2}+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in S.QUERY_STOPWORDS)
_terms = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '{S.WORD_RE2}'), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\p{{Nd}}+') AND x NOT IN ({_STOP})))"
_KINDS = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in S.SOURCE_TYPES.items())
_DOTTED, _COMPACT = r"(\d{1,2})[.\-_](\d{1,2})[.\-_](20\d{2})", r"(?:^|[^0-9])(\d{2})(\d{2})(20\d{2})(?:$|[^0-9])"


def _iso(c: str) -> str:
    g = lambda p, k: f"regexp_extract({c}, '{p}', {k})"
    return f"""CASE WHEN {g(_DOTTED, 3)} <> '' THEN {g(_DOTTED, 3)} || '-' || lpad({g(_DOTTED, 2)}, 2, '0') || '-' || lpad({g(_DOTTED, 1)}, 2, '0')
    WHEN {g(_COMPACT, 3)} <> '' AND TRY_CAST({g(_COMPACT, 2)} AS INT) BETWEEN 1 AND 12 AND TRY_CAST({g(_COMPACT, 1)} AS INT) BETWEEN 1 AND 31 THEN {g(_COMPACT, 3)} || '-' || {g(_COMPACT, 2)} || '-' || {g(_COMPACT, 1)} END"""


_HEADS = "|".join(h for h in S.HONORIFICS if "." not in h)


def norm(column: str) -> str:
    """The match key of a name: what compatibility forms change does not occur in the tables."""
    marks = r"""[.·,;:!?''"()\[\]{}<>/\\|_*`~‘’“”-]"""
    plain = f"trim(regexp_replace(lower(nfc_normalize({column})), '(?:{marks}|{SPACE_RE2})+', ' ', 'g'))"
    return f"regexp_replace({plain}, '^(?:(?:{_HEADS})(?: |$))+', '')"


SQL = {
    "halve_texts": "SELECT doc_id, length(trim(text[:cut], ' '))::INT AS left, length(trim(text[cut + 1:], ' '))::INT AS right FROM (SELECT *, CASE WHEN contains(a, ' ') AND (NOT contains(b, ' ') OR l <= r) THEN mid - l WHEN contains(b, ' ') THEN mid + r ELSE mid END AS cut FROM (SELECT *, length(regexp_extract(a, '(?s) ([^ ]*)$', 1)) AS l, length(regexp_extract(b, '(?s)^([^ ]*) ', 1)) AS r FROM (SELECT doc_id, text, mid, substr(text, mid - 199, 200) AS a, substr(text, mid + 1, 200) AS b FROM (SELECT doc_id, text, length(text) // 2 AS mid FROM documents WHERE length(text) >= 800))))",
    "clean_ocr": f"SELECT segment_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '[\\x{{200c}}\\x{{ad}}]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: NOT regexp_matches(x, '^[-=_*~|. ]+$') AND NOT regexp_full_match(x, '[^\\p{{L}}\\p{{N}}]')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{SPACE_RE2}+', ''), '{SPACE_RE2}+$', '') AS text FROM (SELECT DISTINCT segment_id, text_original AS t FROM segments WHERE source_type = 'news_clip')",
    "source_types": f"SELECT CASE {_KINDS} END AS kind, count(*) AS n FROM (SELECT lower(regexp_extract(source_file, '\\.([^./]+)$', 1)) AS ext FROM chunks) GROUP BY 1",
    "detect_language": f"SELECT {_LANG} AS detected, language, count(*) AS n FROM ({_COUNTS.replace('{}', 'chunks')}) GROUP BY 1, 2",
    "content_hash_copies": f"SELECT hash, count(*) AS copies, count(*) FILTER (hash = content_hash) AS labelled FROM (SELECT sha1({_SQUEEZE.replace("{}", "text")}) AS hash, content_hash FROM chunks) GROUP BY 1 HAVING count(*) > 1",
    "filter_passages": "SELECT chunk_id, date FROM chunks WHERE language = 'te' AND source_type = 'source_doc' AND date >= '2025-01-01' AND date <= '2025-12-31'",
    "filter_glob": "SELECT source_file, count(*) AS n FROM chunks WHERE source_file LIKE '%annexures/set _/%.pdf%' GROUP BY 1",
    "meet_of_path": f"SELECT source_file, trim(bits[1]) AS meet, coalesce({_iso('folder')}, {_iso('source_file')}) AS date, CASE WHEN len(bits) >= 3 THEN trim(array_to_string(bits[3:], '_')) WHEN len(bits) = 2 THEN trim(bits[2]) ELSE folder END AS topic FROM (SELECT source_file, folder, string_split(folder, '_') AS bits FROM (SELECT DISTINCT source_file, CASE WHEN len(string_split(source_file, '/')) > 1 THEN string_split(source_file, '/')[2] ELSE source_file END AS folder FROM chunks))",
    "citation_labels": "SELECT chunk_id, concat_ws(' ', nullif(publication, ''), string_split(source_file, '/')[-1], 'p.' || page, 'slide ' || slide, '@ ' || lpad((floor(video_start)::INT // 60)::VARCHAR, 2, '0') || ':' || lpad((floor(video_start)::INT % 60)::VARCHAR, 2, '0'), '(' || nullif(date, '') || ')') AS label FROM (SELECT DISTINCT chunk_id, source_file, publication, page, slide, video_start, date FROM chunks)",
    "tag_density": "SELECT doc_id, density FROM (SELECT doc_id, round((length(text) - length(regexp_replace(text, '<[^>]{1,40}>', '', 'g'))) / greatest(length(text), 1), 6) AS density FROM documents) WHERE density > 0",
    "token_estimate": rf"SELECT doc_id, (floor(length(text) / CASE WHEN length(h) - length(regexp_replace(h, '[\x{{0900}}-\x{{0D7F}}]', '', 'g')) > 0.2 * greatest(length(h), 1) THEN 4.0 ELSE 5.0 END)::INT + 1)::INT AS tokens FROM (SELECT doc_id, text, substr(text, 1, 2000) AS h FROM documents)",
    "query_terms": f"SELECT item_id, array_to_string(list_sort({_terms('q')}), ' ') AS terms FROM eval_items",
    "latin_texts": rf"SELECT CASE WHEN l > 0 THEN a > 0.6 * l ELSE false END AS latin, count(*) AS n FROM (SELECT length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS l, {_EN} AS a FROM chunks) GROUP BY 1",
    "clip_texts": rf"SELECT doc_id, CASE WHEN length(s) <= 200 THEN s WHEN contains(h, ' ') THEN regexp_extract(h, '(?s)^(.*) ', 1) || ' …' ELSE h || ' …' END AS clip FROM (SELECT doc_id, s, substr(s, 1, 200) AS h FROM (SELECT doc_id, {_SQUEEZE.replace("{}", "text")} AS s FROM documents))",
    "jaccard_terms": f"SELECT item_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM (SELECT item_id, {_terms('q')} AS a, {_terms('passage')} AS b FROM eval_items)",
    "normalise_names": f"SELECT entity_id, coalesce({norm('name')}, '') AS name FROM entities",
    "split_pages": r"SELECT segment_id, (i - 1)::INT AS page, length(trim(p[i], ' '))::INT AS n FROM (SELECT segment_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT segment_id, CASE WHEN contains(t, chr(12)) THEN string_split(t, chr(12)) ELSE string_split_regex(t, '(?m)^---+[ \t]*$') END AS p FROM (SELECT DISTINCT segment_id, text_original AS t FROM segments WHERE text_original IS NOT NULL)))",
    "select_chunks": "SELECT chunk_id, CASE WHEN length(text) < 150 THEN 'short' WHEN density >= 0.5 THEN 'markup' WHEN row_number() OVER (PARTITION BY CASE WHEN length(text) < 150 OR density >= 0.5 THEN chunk_id ELSE key END ORDER BY source_file, chunk_id) > 1 THEN 'duplicate' END AS skip FROM (SELECT *, coalesce(nullif(content_hash, ''), chunk_id) AS key, (length(text) - length(regexp_replace(text, '<[^>]{1,40}>', '', 'g'))) / greatest(length(text), 1) AS density FROM (SELECT DISTINCT chunk_id, text, content_hash, source_file FROM chunks))",
    "question_ngrams": f"SELECT item_id, count(*) AS n, max(length(t))::INT AS longest FROM (SELECT item_id, array_to_string(w[i:i+k-1], ' ') AS t FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, unnest(range(1, 6)) AS k FROM (SELECT item_id, list_filter(string_split({norm('q')}, ' '), lambda x: x <> '') AS w FROM eval_items)))) GROUP BY 1",
    "dates_checked": "SELECT CASE WHEN date IS NULL THEN 'none' WHEN try_cast(date AS DATE) IS NULL THEN 'impossible' ELSE 'real' END AS kind, count(*) AS n FROM extracted_docs GROUP BY 1",
}

_PAGES = r"SELECT segment_id, unnest(range(1, len(p) + 1)) AS page, unnest(list_transform(p, lambda x: trim(x, ' '))) AS text FROM (SELECT segment_id, CASE WHEN contains(t, chr(12)) THEN string_split(t, chr(12)) ELSE string_split_regex(t, '(?m)^---+[ \t]*$') END AS p FROM (SELECT segment_id, regexp_replace(t, '!\[[^\]]*\]\(data:[^)]*\)', '', 'g') AS t FROM (SELECT DISTINCT segment_id, text_original AS t FROM segments WHERE text_original IS NOT NULL)))"
SQL |= {
    "repaired_pages": f"SELECT segment_id, page::INT AS page, language, size::INT AS n FROM (SELECT segment_id, page, {_LANG} AS language, length(text) AS size FROM ({_COUNTS.replace('{}', f'({_PAGES})')}) WHERE length(text) >= 12)",
    "select_chunks_capped": "WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, text, content_hash, source_file, source_type FROM chunks), g AS (SELECT chunk_id, source_file, coalesce(nullif(content_hash, ''), chunk_id) AS key, CASE WHEN source_type NOT IN (%s) THEN 'source_type' WHEN length(text) < 150 THEN 'short' WHEN (length(text) - length(regexp_replace(text, '<[^>]{1,40}>', '', 'g'))) / greatest(length(text), 1) >= 0.5 THEN 'markup' END AS skip FROM c), o AS (SELECT chunk_id, source_file, key, row_number() OVER (ORDER BY source_file, chunk_id) AS rn FROM g WHERE skip IS NULL), w(rn, chunk_id, skip, seen, kept) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT rn, chunk_id, s, CASE WHEN s IS NULL THEN list_append(seen, key) ELSE seen END, CASE WHEN s IS NULL THEN list_append(kept, source_file) ELSE kept END FROM (SELECT o.*, w.seen, w.kept, CASE WHEN len(list_filter(w.kept, lambda f: f = o.source_file)) >= 60 THEN 'over_file_cap' WHEN list_contains(w.seen, o.key) THEN 'duplicate' END AS s FROM w JOIN o ON o.rn = w.rn + 1)) SELECT chunk_id, skip FROM w WHERE rn > 0 UNION ALL SELECT chunk_id, skip FROM g WHERE skip IS NOT NULL" % ", ".join(f"'{k}'" for k in _WANTED),
}
