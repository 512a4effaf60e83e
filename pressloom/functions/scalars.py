"""Scalar functions of the archive, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.text import squeeze, strip

#: Fixed: file extensions of each kind of source.
SOURCE_TYPES = {
    "press_release": ("docx", "doc", "rtf"),
    "source_doc": ("pdf",),
    "slide": ("pptx", "ppt"),
    "table": ("xlsx", "xls", "csv"),
    "news_clip": ("jpg", "jpeg", "png"),
    "video": ("mp4", "mov", "mkv", "m4a", "mp3", "wav"),
}
#: Fixed: words that carry nothing in a question.
QUERY_STOPWORDS = "what which when where why how did does said say about the and with from into were was are its his her their this that గురించి ఏమన్నారు ఏమిటి ఏమి చెప్పారు".split()
#: Fixed: words that name no entity and no topic.
TOPIC_STOPWORDS = "what who when where why how did does do is are was were the a an of in on at to for about and or he she they it his her their said say says tell me all any which that this press meet meets conference news".split()
#: Fixed: honorifics before a name.
HONORIFICS = "sri shri smt smt. mr mr. mrs mrs. ms ms. dr dr. shree sree శ్రీ శ్రీమతి డా".split()
#: Fixed: locale of each language.
LOCALES = {"te": "te-IN", "hi": "hi-IN", "en": "en-IN", "ur": "ur-IN"}

#: Runs of word characters: letters, numbers, and all of Telugu and Devanagari.
WORD = r"[\p{L}\p{N}_ఀ-౿ऀ-ॿ]+"
WORD_RE2 = r"[\p{L}\p{N}_\x{0C00}-\x{0C7F}\x{0900}-\x{097F}]+"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def detect_language(text: Column) -> Column:
    """te, hi or en by the script of most letters; mixed where a second script has a quarter
    of them or none has half; unknown without letters. Null stays null."""
    counts = F.struct(*[count_chars(text, c).alias(k) for k, c in (("te", "ఀ-౿"), ("hi", "ऀ-ॿ"), ("en", "A-Za-z"))])

    def decide(c: Column) -> Column:
        te, hi, en = c["te"], c["hi"], c["en"]
        n = (te + hi + en).cast("double")
        top = F.greatest(te, hi, en)
        second = te + hi + en - top - F.least(te, hi, en)
        return (
            F.when(n == 0, "unknown").when(second / n >= 0.25, "mixed").when(top / n < 0.5, "mixed").when(te == top, "te").when(hi == top, "hi").otherwise("en")
        )

    # an array of one binds the counts, so that they are taken once
    return F.when(text.isNotNull(), F.get(F.transform(F.array(counts), decide), F.lit(0)))


def source_type(path: Column) -> Column:
    """Kind of a source by its extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda acc, kv: acc.when(ext.isin(*kv[1]), kv[0]), SOURCE_TYPES.items(), F.when(F.lit(False), None))


def iso_date(text: Column) -> Column:
    """The first dotted day as a string, unchecked; else the first DDMMYYYY that is one."""
    d = [F.regexp_extract(text, r"(\d{1,2})[.\-_](\d{1,2})[.\-_](20\d{2})", k) for k in (1, 2, 3)]
    c = [F.regexp_extract(text, r"(?<!\d)(\d{2})(\d{2})(20\d{2})(?!\d)", k) for k in (1, 2, 3)]
    month, day = c[1].try_cast("int"), c[0].try_cast("int")
    return F.when(d[2] != "", F.concat_ws("-", d[2], F.lpad(d[1], 2, "0"), F.lpad(d[0], 2, "0"))).when(
        (c[2] != "") & month.between(1, 12) & day.between(1, 31), F.concat_ws("-", c[2], c[1], c[0])
    )


def meet_of(path: Column) -> dict[str, Column]:
    """Id, date, topic and title of the press meet in whose folder a file lies."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))
    bits = F.split(folder, "_")
    topic = F.when(F.size(bits) >= 3, F.trim(F.array_join(F.slice(bits, 3, 1000), "_"))).when(F.size(bits) == 2, F.trim(F.element_at(bits, 2))).otherwise(folder)
    return {"press_meet_id": F.trim(F.element_at(bits, 1)), "date": F.coalesce(iso_date(folder), iso_date(path)), "topic": topic, "press_meet_title": folder}


def publication(name: Column, keys: dict[str, str]) -> Column:
    """The publication of the first key, in order, that a file name contains."""
    low = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return reduce(lambda acc, kv: acc.when(low.contains(kv[0]), kv[1]), keys.items(), F.when(F.lit(False), None))


def citation_label(source_file: Column, publication: Column, page: Column, slide: Column, start: Column, date: Column) -> Column:
    """Readable citation: publication, file, page, slide, time and date, where there are any."""
    seconds = start.cast("int")
    clock = F.concat(F.lit("@ "), F.lpad((seconds / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.concat_ws(
        " ",
        F.when(publication != "", publication),
        F.element_at(F.split(source_file, "/"), -1),
        F.concat(F.lit("p."), page.cast("int").cast("string")),
        F.concat(F.lit("slide "), slide.cast("int").cast("string")),
        clock,
        F.when(date != "", F.concat(F.lit("("), date, F.lit(")"))),
    )


def tag_density(text: Column) -> Column:
    """Share of a text that markup tags make up."""
    return (F.length(text) - F.length(F.regexp_replace(text, r"<[^>]{1,40}>", ""))) / F.greatest(F.length(text), F.lit(1))


def strip_data_uris(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\(data:[^)]*\)", "")


def chars_per_token(text: Column) -> Column:
    """4 where more than a fifth of the first 2000 characters is Indic, else 5."""
    head = F.substring(text, 1, 2000)
    return F.when(count_chars(head, "ऀ-ൿ") > 0.2 * F.greatest(F.length(head), F.lit(1)), 4.0).otherwise(5.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / chars_per_token(text)).cast("int") + 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct words that may decide a match: over two characters, no figures, no stopwords."""
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Nd}+$") & ~F.array_contains(stop, w)))


def is_latin(text: Column) -> Column:
    """Whether over 60 percent of the letters are ASCII."""
    letters = count_chars(text, r"\p{L}")
    return F.when(letters > 0, count_chars(text, "A-Za-z") > 0.6 * letters).otherwise(False)


def clip(text: Column, n: int) -> Column:
    """Squeezed text; over n characters, cut at the last space before n, with an ellipsis."""
    s = squeeze(text)
    head = F.substring(s, 1, n)
    cut = F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(cut, F.lit(" …")))


def evidence_window(text: Column, quote: Column, n: int) -> Column:
    """n characters of a text that begin a third of n before the quote."""
    s, q = squeeze(text), squeeze(quote)
    at = F.call_function("locate", q, s)
    start = F.greatest(at - F.lit(n // 3), F.lit(1))
    return F.when(F.length(s) <= n, s).otherwise(F.substring(s, start, F.lit(n)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def locale(language: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(language == kv[0], kv[1]), LOCALES.items(), F.when(F.lit(False), None))


def clean_ocr(text: Column) -> Column:
    """Lines without joiners and soft hyphens, single spaces, and lines of one mark dropped."""
    plain = F.regexp_replace(text, "[‌­]", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = F.filter(lines, lambda x: ~x.rlike(r"^[-=_*~|. ]+$") & ~x.rlike(r"^[^\p{L}\p{N}]$"))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


_PUNCT = re.compile(r"[.·,;:!?'\"()\[\]{}<>/\\|_*`~‘’“”-]+")


def normalise_name(name: str | None) -> str:
    """Match key of a name: compatibility form, folded case, no marks, no honorifics before it."""
    s = _PUNCT.sub(" ", unicodedata.normalize("NFKC", name or "").strip().casefold())
    parts = s.split()
    while parts and parts[0] in HONORIFICS:
        parts.pop(0)
    return " ".join(parts)


def normalise(name: Column) -> Column:
    """normalise_name for columns: built-in for ASCII, an Arrow function for the rest."""
    ascii_ = F.trim(F.regexp_replace(F.lower(name), r"[\s.,;:!?'\"()\[\]{}<>/\\|_*`~-]+", " "))
    heads = "|".join(h for h in HONORIFICS if h.isascii() and "." not in h)
    plain = F.regexp_replace(ascii_, rf"^(?:(?:{heads})(?: |$))+", "")
    return F.when(name.isNull(), "").when(name.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_normalise_udf()(name))


def _normalise_udf():
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(normalise_name)

    return fold


def json_object(text: Column, schema: str) -> Column:
    """The object in a model's reply: as it stands, inside a fence, or between its outer
    braces; null where none of them parses."""
    raw = F.trim(text)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), F.from_json(c, schema, options))
    return F.coalesce(good(raw), good(fenced), good(outer))


def repair_truncated_json(text: str | None) -> str | None:
    """A cut-off JSON text closed after its last complete element, or None."""
    if not text:
        return None
    stack: list[str] = []
    safe: list[tuple[int, tuple]] = []
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            if c == "[":  # an empty list is an element, an empty object would be an invented one
                safe.append((i + 1, tuple(stack)))
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[: i + 1]
            safe.append((i + 1, tuple(stack)))
        elif c == "," and stack:
            safe.append((i, tuple(stack)))
    import json

    for at, open_ in reversed(safe):
        candidate = text[:at].rstrip().rstrip(",") + "".join(reversed(open_))
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None
