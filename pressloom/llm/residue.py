"""Problem 10: template residue, filler, error pages and script notices.

Every document is looked at once, whole. Slots that were never filled are found in place.
What is left of any document without headings, menu and copyright lines is a message, of
any length, with figures and codes masked. Messages are mined into templates by a prefix
tree of fixed depth (length, then the first tokens), one leaf per group of rows; a path
that holds many messages is salted into shards. A template is classified once, by its
constant words alone: what stands in its slots, a name that quotes or an odd word, has no
say. The verdict is propagated to all its messages and from them to the documents by a join.

A template's constant words stand in each of its messages. A message therefore never reaches
the tree if too few of its words stand in sentences with a word any evidence needs: no
template of it could be residue. That keeps ordinary text out of the shuffle and is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut_lineage, spread
from pressloom.sources.tables import table

#: Least share of a template's words that stand in sentences with evidence.
COVERED = 0.3
#: Tokens below the length node of the prefix tree, and messages in one shard of a leaf.
DEPTH, SHARD = 2, 4000
#: Least share of equal tokens for a message to join a template of its leaf.
ALIKE = 0.5

_LETTER = r"[^\W\d_]"
_MARKED = r"[\w ऀ-ൿ.|-]"
_TAGS = "a abbr article b blockquote body br center code div em font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link meta nav noscript ol p pre q s script section small span strong style sub sup table tbody td th thead title tr tt u ul wbr".split()
_NOTES = "sic inaudible applause laughter laughs crosstalk unclear emphasis pause interruption note ibid".split()
SLOT = re.compile(
    "|".join(
        [
            r"\{\{[^{}\n]{0,80}\}\}",
            r"\{%[^%\n]{1,80}%\}",
            r"<%[^%\n]{1,80}%>",
            r"\$\{[^{}\n]{1,60}\}",
            r"%\([^()\n]{1,40}\)[sdif]\b",
            rf"(?<![\w%])%[^\W\d][\wऀ-ൿ]{{1,40}}%(?!\w)",
            rf"(?<![\w#&])#[^\W\d][\wऀ-ൿ]{{1,40}}#(?!\w)",
            r"@@[\wऀ-ൿ]{2,40}@@",
            r"@Model\.[\wऀ-ൿ]+",
            r"\[\[[^\[\]\n]{1,40}\]\]",
            r"<<[^<>\n]{1,40}>>",
            rf"«(?=[^»]*{_LETTER})(?![^»]*[A-Z.,;!?])[\w ऀ-ൿ]{{2,24}}»",
            rf"\{{(?!(?:{'|'.join(_NOTES)})\}})(?:\d{{1,2}}|[a-zऀ-ൿ][\wऀ-ൿ ]{{1,30}})\}}",
            rf"<(?!/|(?:{'|'.join(_TAGS)})\b)[a-zऀ-ൿ][\wऀ-ൿ ]{{1,30}}>",
            r"\[(?i:insert|your|enter|add|type|fill in)\b[^\[\]\n]{1,40}\]",
            r"\[[^\[\]\n]{1,40}\b(?i:here|tbd|tba|tbc|to be (?:filled|added|confirmed|decided)|pending entry|insert before print|x{3,})\]",
            r"\[object Object\]",
            r"\bX{2}[./-]X{2}[./-](?:20)?X{2}",
            r"_{2}/_{2}/(?:20)?_{2}",
            r"(?:Rs\.?|₹|\$|रु\.|రూ\.)\s?_{2,}",
        ]
    )
)
_HINT = re.compile(r"[{\[<«%#@$_]|XX")
_MENU = re.compile(r"\s[|»›·]\s")
_HEADING = re.compile(r"#{1,6}\s|={3,}|-{3,}|\*(?:\s?\*){2,}\s*$")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_ENDS = re.compile(r"[.!?।॥۔。！？…:;\"”’')\]>]$")
_SENTENCE = re.compile(r"(?<=[.!?।॥۔。！？…])\s*")
_MASKS = [(re.compile(r"\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{4,}\b"), "<h>"), (re.compile(r"\d+(?:[.,:/-]\d+)*"), "<n>")]

#: Evidence that a template speaks for a system and not for a person, by kind.
_EVIDENCE = {
    "error": re.compile(
        r"not found\b|bad gateway|gateway time-?out|internal (?:server )?error|service unavailable|\bforbidden\b|access denied|permission to (?:view|access|open)"
        r"|could not be (?:completed|checked|loaded|displayed|verified|opened|reached)|connection (?:lost|refused|reset|timed out|closed)|(?:has|have) (?:expired|timed out)|(?:log|sign) ?in again"
        r"|too many requests|rate limit|wait <n> (?:second|minute)|try again|try the home page|went wrong|please reload|^reload\b|\. reload\b|moved or deleted|been (?:moved|deleted|removed)"
        r"|no longer (?:available|exists)|maintenance|come back (?:after|later)|traceback|exception\b|stack trace|value is none|nullpointer|page you (?:asked|requested|are looking)"
        r"|cannot be (?:displayed|reached|found|opened)|out of date or|unsupported browser|failed at line|at your own risk|\b(?:error|status) (?:code )?<[nh]>|unexpected (?:error|token)|temporarily unavailable|try later|server (?:error|is busy|did not)|timed out"
        r"|కనుగొనబడలేదు|కనబడలేదు|అందుబాటులో లేదు|మళ్లీ ప్రయత్నించండి|సర్వర్|లోపం (?:సంభవించింది|జరిగింది)|उपलब्ध नहीं है।? कृपया|प्रयास करें|पृष्ठ (?:नहीं|उपलब्ध)|सर्वर|त्रुटि|صفحہ (?:نہیں|دستیاب|موجود)|دوبارہ کوشش|سرور|页面(?:不存在|未找到|无法|找不到)|找不到(?:页面|该页)|服务器(?:错误|繁忙)|内部错误|稍后(?:再试|重试)|出错了",
        re.I,
    ),
    "script": re.compile(
        r"java ?script|enable (?:\w+ and )?(?:scripts?|cookies)|(?:allow|turn on|switch on|activate|permit) (?:scripts?|scripting)|scripts? (?:is|are) (?:required|disabled|switched off|blocked|needed)|with scripting|<noscript>|blocks active content|you are (?:a )?human|not a robot"
        r"|జావాస్క్రిప్ట్|స్క్రిప్ట్(?:లు|ల)|जावास्क्रिप्ट|स्क्रिप्ट|جاوا ?اسکرپٹ|اسکرپٹ|启用(?:脚本|JS)|开启(?:脚本|JS)|脚本",
        re.I,
    ),
    "value": re.compile(r"^(?!(?:<\*>\s*)+$)(?:(?:null|undefined|nan|none|nil|n/a|#ref!|#name\?|#value!|#n/a|#div/0!|#null!|#num!|\[object object\]|<[nh*]>)\s*)+$", re.I),
    "filler": re.compile(
        r"\blorem\b|\bipsum\b|dummy (?:text|copy|paragraph|content)|sample (?:text|copy|content|paragraph)|body copy|headline (?:one|goes|here|<n>)|(?:text|content|copy|title) (?:goes|comes) here|coming soon|place ?holder|mock-?up|copy follows|replace later|to be replaced|for layout only|this (?:page|space) (?:is )?intentionally"
        r"|नमूना पाठ|పాఠ్యం ఇక్కడ|నమూనా (?:వచనం|పాఠ్యం)|نمونہ (?:متن|عبارت)|示例(?:文本|文字)|占位",
        re.I,
    ),
}
#: Signs that a person reports or discusses a message.
_REPORTED = re.compile(r"\b(?:said|says|complained|alleged|according to|asked (?:who|why|the|about)|greeted|held up|called it|were told|told (?:the|reporters)|left .{1,60} waiting|in a row|was changed on|explained|wrote that|read the|laughed)\b|[“‘\"][^“”‘’\"]{3,}[”’\"]", re.I)
_LATIN_FILLER = re.compile(
    r"(?:lorem|ipsum|dolor|sit|amet|conse[cq]\w*|adipi\w*|elit|sed\w{0,2}|eiusm\w*|temp[oi]\w*|incid\w*|labor\w*|dolore\w*|magn[ai]\w*|aliqu\w*|nulla\w*|semper|ornar\w*|vita\w*|turpi\w*|fauci\w*|rutrum|porta|dapib\w*|augu\w*|vel\w{0,3}|feli[xcs]\w*|lacin\w*|morb\w*|quo\w{0,3}|biben\w*|pellen\w*|ut|et|in|ad|minim|veniam|quis|nisi|ex|ea|enim|ac|at|non|nec|eget|diam|risus|massa|nunc|urna|ante|orci|cras|justo|purus|metus|mauris|tortor|viverra|volutpat|vestib\w*|maecen\w*|praes\w*|curab\w*|susp\w*|ultri\w*|tincid\w*|malesu\w*|phare\w*|sagit\w*|pulvin\w*|portti\w*|plac\w*|commod\w*|cursus|lectus|libero|ligula|lobor\w*|luctus|mollis|neque|odio)$"
)
_KEYS = re.compile(r"(?:asdf|qwer|zxcv|hjkl|jkl|dfgh|fghj|cvbn|vbnm|tyui|uiop|poiu|lkjh|abc|xyz|abcd|aaa+|bbb+|xxx+|zzz+|test\w?|foo|bar|baz|blah|[asdfghjkl]{4,}|[qwertyuiop]{5,}|[zxcvbnm]{4,}|\d+)$")


#: Each evidence needs one of these, in lower case.
_NEEDED = (
    "not found|bad gateway|gateway time|server error|internal error|service unavailable|forbidden|access denied|permission to|could not be|connection |expired|timed out|in again|too many requests|rate limit|wait |try |went wrong|reload|moved or|been moved|been deleted|been removed"
    "|no longer|maintenance|come back|traceback|exception|stack trace|value is none|nullpointer|page you|cannot be|out of date|unsupported browser|failed at|own risk|code |error |status |unexpected |unavailable|server is|server did|సర్వర్|కనుగొన|కనబడ|అందుబాటులో|మళ్లీ|లోపం|उपलब्ध|प्रयास|पृष्ठ|सर्वर|त्रुटि|صفحہ|دوبارہ|سرور|页面|找不到|服务器|内部错误|稍后|出错"
    "|script|cookies|human|a robot|active content|జావాస్క్రిప్ట్|స్క్రిప్ట్|जावास्क्रिप्ट|स्क्रिप्ट|اسکرپٹ|启用|开启|脚本"
    "|lorem|ipsum|dummy |sample |body copy|headline |goes here|comes here|coming soon|place|mock|copy follows|replace|for layout|intentionally|नमूना|పాఠ్యం|నమూనా|نمونہ|示例|占位"
).split("|")
_AUTOMATON: list = []


def _needed(low: str) -> bool:
    """Whether a text in lower case holds a word that evidence needs."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for w in _NEEDED:
            a.add_word(w, True)
        a.make_automaton()
        _AUTOMATON.append(a)
    return next(_AUTOMATON[0].iter(low), None) is not None


def core(text: str) -> str:
    """The text without menu and copyright lines and the heading over it."""
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    kept = [x for x in lines if not (_COPYRIGHT.match(x) or _HEADING.match(x) or (len(x) < 80 and _MENU.search(x) and not _ENDS.search(x)))]
    if len(kept) > 1 and len(kept[0]) < 90 and not _ENDS.search(kept[0]) and (" — " in kept[0] or " – " in kept[0] or kept[0].isupper()):
        kept = kept[1:]
    return "\n".join(kept or lines)


def _units(text: str) -> list[str]:
    return [x for x in (y.strip() for line in text.split("\n") for y in _SENTENCE.split(line)) if x]


def message(text: str) -> str | None:
    """The masked message that stands for the whole document, its sentences parted by <br>, or
    None where no template of it could be residue. Each repeated sentence stands once, with
    the mark <rep>."""
    body = core(text)
    units = _units(body)
    if not units:
        return None
    low = body.lower()
    tokens = low.split()
    distinct = set(units)
    repeats = len(units) >= 3 and len(distinct) <= max(1, len(units) // 3)
    if not repeats and (_mostly(tokens, _LATIN_WORDS, _LATIN_FILLER, 0.6) or _mostly(tokens, _KEY_WORDS, _KEYS, 0.8)):
        return "<latin>"
    if not repeats and not _needed(low) and len(set(tokens)) > 1 and not (_VALUE.match(low) and _EVIDENCE["value"].match(_masked(low))):
        return None
    units = [_masked(x) for x in units]
    if repeats:
        return " <br> ".join([*dict.fromkeys(units), "<rep>"])
    if len(tokens) >= 4 and len(set(tokens)) == 1:
        return " <br> ".join([units[0].split()[0], "<rep>"])
    said = " <br> ".join(units)
    if _EVIDENCE["value"].match(said.replace(" <br> ", " ")):
        return said
    words = [(len(x.split()), x) for x in units]
    most = sum(n for n, x in words if _needed(x.lower()))
    return said if most >= COVERED * sum(n for n, _ in words) else None


def _masked(text: str) -> str:
    for mask, name in _MASKS:
        text = mask.sub(name, text)
    return text


_VALUE = re.compile(r"null|undefined|nan|none|nil|n/a|#|\[object|\d|[a-f]+\d")
_LATIN_WORDS: dict[str, bool] = {}
_KEY_WORDS: dict[str, bool] = {}


def _mostly(tokens: list[str], known: dict[str, bool], pattern: re.Pattern, share: float) -> bool:
    """Whether more than a share of at least four tokens match, looked at until it is certain."""
    if len(tokens) < 4:
        return False
    if len(known) > 200_000:
        known.clear()
    room = (1 - share) * len(tokens)
    letters = False
    for t in tokens:
        fits = known.get(t)
        if fits is None:
            fits = known[t] = pattern.match(t.strip(".,;:!?")) is not None
        if not fits:
            room -= 1
            if room <= 0:
                return False
        elif not letters:
            letters = any(c.isalpha() for c in t)
    return letters


def path(message_text: str) -> str:
    """Node of the fixed-depth tree: number of tokens, then the first of them; those with
    figures or a capital inside the message are variable."""
    tokens = message_text.split()
    head = ["<*>" if "<" in t or (i and t[:1].isupper()) else t for i, t in enumerate(tokens[:DEPTH])]
    return " ".join([str(len(tokens)), *head])


def mine(messages: list[str]) -> list[str]:
    """The template of each message of one leaf, in order of first sight of sorted messages."""
    order = sorted(range(len(messages)), key=messages.__getitem__)
    templates: list[list[str]] = []
    where: dict[int, int] = {}
    for i in order:
        tokens = messages[i].split()
        best, score = -1, 0.0
        for k, t in enumerate(templates):
            if len(t) == len(tokens):
                same = sum(1 for a, b in zip(t, tokens) if a == b) / len(t)
                if same > score:
                    best, score = k, same
        if best >= 0 and score >= ALIKE:
            templates[best] = [a if a == b else "<*>" for a, b in zip(templates[best], tokens)]
        else:
            best = len(templates)
            templates.append(tokens)
        where[i] = best
    return [" ".join(templates[where[i]]) for i in range(len(messages))]


def verdict(template: str) -> str | None:
    """Kind of residue of a template, judged by its constant words: sentences with evidence of
    one kind hold enough of its words, and nobody reports them."""
    if template == "<latin>" or template.endswith("<rep>"):
        return "filler"
    if _EVIDENCE["value"].match(template.replace("<br>", " ")):
        return "value"
    units = [u for part in template.split("<br>") for u in _units(part)]
    text = "\n".join(units)
    if _REPORTED.search(text):
        return None
    words = [len(u.split()) for u in units]
    some = [n for n, u in zip(words, units) if any(_EVIDENCE[k].search(u) for k in ("script", "error", "filler"))]
    if not some or sum(some) < COVERED * sum(words):
        return None
    return next(k for k in ("script", "error", "filler") if _EVIDENCE[k].search(text))


def residue(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, reason, detail): documents that hold residue instead of content.

    reason is slot, error, script, value or filler; detail is the first slot, or the
    template of the message. A document with both is a slot. Null, empty and blank texts
    hold no residue and have no row. Repeated rows give repeated rows. Other columns are
    not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kind = docs.schema[doc_id].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, slots, said = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                hit = SLOT.search(t) if _HINT.search(t) else None
                m = None if hit else message(t)
                if hit or m:
                    at.append(i)
                    slots.append(hit.group(0) if hit else None)
                    said.append(m)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(slots, pa.string()), pa.array(said, pa.string()), pa.array([m and path(m) for m in said], pa.string())],
                ["doc_id", "slot", "message", "path"],
            )

    seen = spread(base).mapInArrow(look, f"doc_id {kind}, slot string, message string, path string")
    return _judged(cut_lineage(seen))  # read four times below


def judge(messages: list[str]) -> list[tuple[str, str, str]]:
    """(message, template, reason) of the messages of one leaf that are residue; a template is
    classified once and its verdict holds for all its messages."""
    found = mine(messages)
    known = {t: verdict(t) for t in dict.fromkeys(found)}
    return [(m, t, known[t]) for m, t in zip(messages, found) if known[t]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["message", "template", "reason"])


def _judged(seen: DataFrame) -> DataFrame:
    counts = seen.where("message is not null").groupBy("path", "message").agg(F.count("*").alias("n"))
    shards = counts.groupBy("path").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("shards"))
    salted = counts.join(shards, "path").withColumn("salt", F.pmod(F.xxhash64("message"), F.col("shards")))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, messages = None, []
        for b in batches:
            out: list[tuple] = []
            for p, s, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (p, s) != key:
                    out += judge(messages)
                    key, messages = (p, s), []
                messages.append(m)
            yield _rows(out)
        yield _rows(judge(messages))

    # a leaf's messages come one after another, at most about SHARD of them
    rows = salted.select("path", "salt", "message").repartition("path", "salt").sortWithinPartitions("path", "salt", "message")
    judged = rows.mapInArrow(leaves, "message string, template string, reason string")
    slots = seen.where("slot is not null").select("doc_id", F.lit("slot").alias("reason"), F.col("slot").alias("detail"))
    rest = seen.where("message is not null").join(judged, "message").select("doc_id", "reason", F.col("template").alias("detail"))
    return slots.unionByName(rest)


def report(spark, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def found(spark, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("doc_id").distinct()


def reasons(spark, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).groupBy("reason").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("detail").alias("n_templates"))
