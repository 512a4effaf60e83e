"""Problem 4: traces of page layout and misreading in text from scanned pages.

Running headers, footers and page numbers leave first, as they also stand inside broken
words. A line is one if it has the form of one and its shape recurs in the corpus, or if it
comes back at the edges of most pages of its text, whatever its form. Words broken across
lines are joined, unless the corpus knows them with their hyphen. Misread characters are
corrected by a noisy channel: every word of a line has the words it may be a misreading of
as candidates, the probability of a confusion is estimated from all words of the corpus,
word and word-pair frequencies are the language model, and Viterbi decoding picks the best
line. A word that no frequent word explains is spelled again: confusions are undone where
the corpus's n-grams of kinds of characters (letters by script and case, figures, each sign)
find the result so much likelier that it pays for them, and its n-grams of characters choose
among the results. What a word occurs as no more often than misreading explains does not count as evidence for it.
Nothing is taken for misread but by these probabilities.

Corpus statistics are counted over all texts, pre-aggregated in each partition. Only words,
pairs, n-grams and shapes above a fixed share of the corpus are sent to the executors, so
their number has a bound that does not depend on the data. Every counted word is looked up
once for what it may be a misreading of; those for which there is something are sent too.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.sentences import _single
from pressloom.session import cut_lineage, spread
from pressloom.sources.tables import table

#: Words and pairs rarer than one in so many are not in the language model.
SHARE = 200_000
#: How much more frequent a word must be than its misreading.
RATIO = 12
#: Confusions undone in a word.
MOST = 3
#: Probability of an error in a word, of any one unknown word, and weight of word pairs.
ERROR, UNKNOWN, PAIRS = 0.01, 2e-5, 0.7

#: Fixed confusions, misread form -> what stood on the page.
CONFUSIONS = {
    "rn": "m", "cl": "d", "li": "h", "vv": "w", "ii": "u", "c": "e", "†": "t", "5": "s", "0": "o", "|": "i", "1": "l", "9": "g", "6": "b", "8": "B", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
}
_DASH = r"\-‐­¬"
_DASHES = frozenset("-‐\u00ad¬")
_SHAPE = "\x01"
_N = r"[0-9౦-౯०-९۰-۹]"
_DATE = r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d"
_FURNITURE = re.compile(
    "|".join(
        [
            rf"[\W_]*(?:[Pp]\s?[Aa]\s?[Gg]\s?[Ee]|[Pp]g?\.|పేజీ|पृष्ठ|पेज|صفحہ)\s*{_N}{{1,4}}(?:\s*(?:of|OF|/|లో|में से|کل)\s*{_N}{{1,4}})?[\W_]*",
            rf"第\s*{_N}{{1,4}}\s*页(?:\s*[,，/共]*\s*共?\s*{_N}{{1,4}}\s*页)?",
            rf"[-–—:\[\](){{}}*|~=<>•· ]*{_N}{{1,4}}[-–—:\[\](){{}}*|~=<>•· ]*",
            r"[-–—\[\]( ]*[ivx]{1,6}[-–—\]\[) ]*",
            rf"(?:[A-Z][\w&'’.-]*[ ]?){{1,5}}[ |–—-]+{_DATE}(?:\s*[|–—-]?\s*\d{{1,4}})?",
            rf"{_DATE}[ |–—-]+(?:[A-Z][\w&'’.-]*[ ]?){{1,5}}(?:[ |–—-]+\d{{1,4}})?",
            r"\d{1,4}(?:\s{2,}|\s*\|\s*)[A-Z][A-Z&'’. -]+",
            r"[A-Z][A-Z&'’. -]+(?:\s{2,}|\s*\|\s*)\d{1,4}",
            r"(?:https?://|www\.)\S+(?:\s+\d{1,4})?",
            r"\d{1,4}\s+(?:https?://|www\.)\S+",
        ]
    )
)
_LOOSE = re.compile(r"[-–—\[\]( ]*[ivx]{1,6}[-–—\]\[) ]*$|https?://|www\.")
_ANY_FIGURE = re.compile(_N)
_TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}“”‘\"…।॥۔؟،。！？—–/]+")
_BROKEN = re.compile(rf"([^\s\d{_DASH}]+)[{_DASH}][ \t]*$")
_HEAD = re.compile(r"\s*([^\s.,;:!?()“”‘’\"…।॥۔؟،—–/]+)")
_SANE = re.compile(r"[A-Za-z0-9†|'’ﬀ-ﬄ-]+$|[ఀ-౿0-9|'‌‍-]+$|[ऀ-ॿ0-9|'‌‍-]+$|[؀-ۿ0-9|‌-]+$")


class Model:
    """Word and pair frequencies, the confusions with their probabilities, and an index from
    misread forms to the frequent words they may stand for. Forms that are not in the index
    are searched for by learn."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int, confusions: dict[tuple[str, str], float], index: dict[str, list[tuple[str, float]]] | None = None, grams: dict[str, int] | None = None, shapes: dict[str, int] | None = None) -> None:
        self.grams, self.shapes = grams or {}, shapes or {}
        self.words, self.pairs, self.total = words, pairs, max(total, 1)
        self.confusions = confusions
        self.index = index if index is not None else {}
        self.asked: set[str] = set()
        self.odd: dict[str, float] = {}
        self.rules: dict[str, list[tuple[str, str, int, float]]] = defaultdict(list)  # by first character
        for (a, b, k), p in _chains(confusions).items():
            self.rules[a[0]].append((a, b, k, p))

    @cached_property
    def clean(self) -> dict[str, int]:
        """Words a misreading may stand for, with their counts."""
        return {v: n for v, n in self.words.items() if n >= RATIO and len(v) >= 2 and _SANE.match(v)}

    @cached_property
    def most(self) -> int:
        return max(self.clean.values(), default=0)

    @cached_property
    def starts(self) -> set[str]:
        return {v[:i] for v in self.clean for i in range(len(v) + 1)}

    def search(self, w: str) -> list[tuple[str, float]]:
        """(word, log channel) of all clean words from which up to MOST confusions lead to w."""
        if len(w) < 3:
            return []
        spots = [(i, i + len(a), b, k, p) for i, c in enumerate(w) if c in self.rules for a, b, k, p in self.rules[c] if w.startswith(a, i)]
        found: dict[str, float] = {}
        need = RATIO * max(1, self.words.get(w, 0))
        todo = [("", 0, 0, 0, 0.0)] if spots and need <= self.most else []
        while todo:
            head, at, first, used, s = todo.pop()
            v = head + w[at:]
            if used and v != w and self.clean.get(v, 0) >= need:
                found[v] = max(found.get(v, -99.0), s)
            for j in range(first, len(spots) if used < MOST else 0):
                i, end, b, k, p = spots[j]
                if i < at or used + k > MOST:
                    continue
                own = head + w[at:i]
                if own not in self.starts:
                    break
                if own + b in self.starts:
                    todo.append((own + b, end, j + 1, used + k, s + p))
        return sorted(found.items())

    @cached_property
    def letters(self) -> Counter:
        """Runs of two and three characters of the frequent words."""
        out: Counter = Counter()
        for w, n in self.words.items():
            _runs(f"\x02\x02{w.lower()}\x03", n, out)
        return out

    @cached_property
    def kinds(self) -> Counter:
        out: Counter = Counter()
        for g, n in self.grams.items():
            out[g] += n
            out[g[:-1]] += n
        return out

    def likelihood(self, w: str, of: str = "kinds") -> float:
        """log probability of a word's characters, or their kinds, each after the two before it."""
        t = f"\x02\x02{w}\x03"
        counts, out = self.kinds if of == "kinds" else self.letters, 0.0
        for i in range(2, len(t)):
            out += log((counts.get(t[i - 2 : i + 1], 0) + 0.01) / (counts.get(t[i - 2 : i], 0) + 1.0))
        return out

    def spell(self, w: str) -> list[tuple[str, float]]:
        """The likeliest word that up to MOST confusions make of w, where the kinds of its
        characters pay for them; none without a model of characters."""
        if len(w) < 3 or not self.grams or not _SANE.match(w) or not any(c in self.rules for c in w):
            return []
        shown = kinds_of(w)
        if not _SIGN.search(shown) or not any(k in "aAtdux" for k in shown):  # letters for letters pay for nothing
            return []
        own = self.likelihood(shown)
        best, gain, paid = w, 0.0, 0.0
        for _ in range(MOST):
            step = (0.0, 0.0, best, paid)
            for i, c in enumerate(best):
                for a, b, k, p in self.rules.get(c, ()):
                    if k == 1 and best.startswith(a, i):
                        v = best[:i] + b + best[i + len(a) :]
                        g = self.likelihood(kinds_of(v)) - own + paid + p
                        if g > gain:
                            step = max(step, (g + self.likelihood(v.lower(), "letters"), g, v, paid + p), key=lambda x: (x[2] != best, x[0]))
            if step[2] == best:
                break
            _, gain, best, paid = step
        return [(best, gain)] if best != w and gain + log(ERROR) > 0 else []

    def oddity(self, w: str, options: list[tuple[str, float]]) -> float:
        """How much less likely the kinds of a word's characters stand together than those of
        what it may be a misreading of, as a log, at most 0."""
        if not options or not self.grams:
            return 0.0
        if (known := self.odd.get(w)) is None:
            shown = kinds_of(w)
            known = min(0.0, self.likelihood(shown) - max(self.likelihood(kinds_of(v)) for v, _ in options)) if _SIGN.search(shown) else 0.0
            if len(self.odd) > 200_000:
                self.odd.clear()
            self.odd[w] = known
        return known

    def learn(self, tokens: list[str]) -> None:
        """Words that were not counted as they are, such as joined ones, come into the index."""
        if len(self.asked) > 200_000:
            self.asked.clear()
        for w in tokens:
            if w not in self.asked and w not in self.index:
                self.asked.add(w)
                if options := self.search(w) or (self.spell(w) if w not in self.words else []):
                    self.index[w] = options

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """(word, log channel) of the words w may be a misreading of."""
        return self.index.get(w, [])

    def _language(self, w: str, before: str | None) -> float:
        uni = self.words.get(w, 0) / self.total
        c = self.words.get(before, 0) if before else 0
        return PAIRS * self.pairs.get((before, w), 0) / c + (1 - PAIRS) * uni if c else uni

    def decode(self, tokens: list[str]) -> list[str]:
        """Viterbi over the candidates of every token of a line."""
        options = [self.candidates(t) for t in tokens]
        if not any(options):
            return tokens
        states: list[list[tuple[str, float]]] = []
        for t, opts in zip(tokens, options):
            # as itself, a word that misreading explains is as good as unknown
            known = self.words.get(t, 0) / self.total if not opts else 0.0
            states.append([(t, log(1 - ERROR) if known else self.oddity(t, opts)), *[(v, log(ERROR) + s) for v, s in opts]])
        best: list[tuple[float, list]] = []
        for k, opts in enumerate(states):
            if k and len(opts) == 1 and len(states[k - 1]) == 1:  # no choice, so nothing to weigh
                best.append((0.0, [(best[k - 1][1][0][0], 0)]))
                continue
            row = []
            for j, (v, channel) in enumerate(opts):
                itself = j == 0 and len(opts) > 1
                if k == 0:
                    p = UNKNOWN if itself else max(self._language(v, None), UNKNOWN)
                    row.append((channel + log(p), -1))
                    continue
                options_ = []
                for i, (u, _) in enumerate(states[k - 1]):
                    p = UNKNOWN if itself else max(self._language(v, u), UNKNOWN)
                    options_.append((best[k - 1][1][i][0] + channel + log(p), i))
                row.append(max(options_, key=lambda x: (x[0], -x[1])))
            best.append((0.0, row))
        j = max(range(len(states[-1])), key=lambda x: best[-1][1][x][0])
        out = []
        for k in range(len(states) - 1, -1, -1):
            out.append(states[k][j][0])
            j = best[k][1][j][1]
        return out[::-1]


def _chains(confusions: dict[tuple[str, str], float]) -> dict[tuple[str, str, int], float]:
    """(misread form, what stood there, confusions) -> log probability: the confusions, and up
    to MOST of them on one another's characters, as c1 for cl for d."""
    layer = {(a, b): log(p) for (a, b), p in confusions.items()}
    out = {(a, b, 1): p for (a, b), p in layer.items()}
    for k in range(2, MOST + 1):
        longer: dict[tuple[str, str], float] = {}
        for (x, y), s in layer.items():
            for (a, b), p in confusions.items():
                for i in range(1 - len(a), len(y)):  # a is laid over y from i on
                    end = i + len(a)
                    if a[max(0, -i) : len(y) - i] != y[max(0, i) : max(0, end)]:
                        continue
                    left, right = a[: max(0, -i)], a[len(y) - i :]
                    key = (left + x + right, y[: max(0, i)] + b + y[end:])
                    if key[0] != key[1]:
                        longer[key] = max(longer.get(key, -99.0), s + log(p))
        layer = longer
        out |= {(a, b, k): p for (a, b), p in layer.items()}
    return out


def _places(text: str, part: str) -> Iterator[int]:
    i = text.find(part)
    while i >= 0:
        yield i
        i = text.find(part, i + 1)


class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 0x80:
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        elif 0xC00 <= code < 0xC80:
            kind = "t"
        elif 0x900 <= code < 0x980:
            kind = "d"
        elif 0x600 <= code < 0x700:
            kind = "u"
        else:
            kind = "x" if c.isalpha() and not "ﬀ" <= c <= "ﬄ" else c
        self[code] = kind
        return kind


_KINDS = _Kinds()
_SIGN = re.compile(r"[^aAtdux]")


def kinds_of(word: str) -> str:
    """One character for the kind of each: a script's letter, capital, figure, or the sign itself."""
    return word.translate(_KINDS)


_LETTERS = re.compile(r"[A-Za-z]+")
_FIGURES = re.compile(r"\d+")


def shape(line: str) -> str:
    """A line with figures as # and Latin words by their case alone."""
    s = _LETTERS.sub(lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "Aa" if m.group()[0].isupper() else "a", _FIGURES.sub("#", line.strip()))
    return " ".join(s.split())


def has_form(line: str) -> bool:
    """Whether a line has the form of a page number, header or footer."""
    s = line.strip()
    if not s or (s[0].isalpha() and s[-1].isalpha() and s[-1] != "页" and not _LOOSE.match(s)) or not (_ANY_FIGURE.search(s) or _LOOSE.match(s)):
        return False  # every form has a figure at one of its ends, or is one of the loose ones
    return _FURNITURE.fullmatch(s) is not None


def is_furniture(line: str, model: Model) -> bool:
    return has_form(line) and shape(line) in model.shapes


def running(pages: list[list[str]]) -> set[str]:
    """Lines, with figures as #, that stand at the edges of most of three and more pages."""
    if len(pages) < 3:
        return set()
    seen: Counter = Counter()
    for lines in pages:
        full = [x for x in lines if x.strip()]
        seen.update({_FIGURES.sub("#", x.strip()) for x in (full[:1] + full[-1:])})
    return {x for x, n in seen.items() if n >= 3 and 2 * n > len(pages)}


def repair(text: str | None, model: Model) -> tuple[str | None, list[str]]:
    """(text as continuous paragraphs, kinds of noise found)."""
    if not text or not text.strip():
        return text, []
    kinds: set[str] = set()
    lines = []
    pages = [page.split("\n") for page in text.split("\f")]
    repeated = running(pages)
    for page in pages:
        lines.append("")
        for x in page:
            if is_furniture(x, model) or (repeated and _FIGURES.sub("#", x.strip()) in repeated):
                kinds.add("furniture")
            else:
                lines.append(x.rstrip())
    # broken words
    out: list[str] = []
    joined: set[int] = set()
    i = 0
    while i < len(lines):
        line = lines[i]
        while line.rstrip(" \t")[-1:] in _DASHES and (m := _BROKEN.search(line)) and i + 1 < len(lines):
            nxt = i + 1
            while nxt < len(lines) - 1 and not lines[nxt].strip() and nxt < i + 3:
                nxt += 1
            h = _HEAD.match(lines[nxt])
            if not h or not (m.group(1)[-1].isalpha() or ord(m.group(1)[-1]) > 0x8FF) or not (h.group(1)[0].isalpha() or ord(h.group(1)[0]) > 0x8FF or h.group(1)[0] in "0156†|"):
                break
            if not _SANE.match(m.group(1).lstrip("(“‘\"'[") + h.group(1)):
                break
            a, b, dash = m.group(1).lstrip("(“‘\"'["), h.group(1), line.rstrip()[-1]
            if h.group(1)[0].isupper() and dash == "-" and not a.isupper():
                break
            if dash == "-" and model.words.get(f"{a}-{b}", 0) > model.words.get(a + b, 0):
                out.append(line + lines[nxt].lstrip())  # its own hyphen
                line = out.pop()
            else:
                kinds.add("hyphen")
                line = line[: m.end(1)] + lines[nxt].lstrip()
            i = nxt
            joined.add(len(out))
        out.append(line)
        i += 1
    # misread characters
    fixed = []
    for at_line, line in enumerate(out):
        if not line.strip():
            fixed.append("")
            continue
        tokens = _TOKEN.findall(line)
        if at_line in joined:
            model.learn(tokens)
        best = model.decode(tokens) if any(t in model.index for t in tokens) else tokens
        if best != tokens:
            kinds.add("glyph")
            parts, at = [], 0
            for m, v in zip(_TOKEN.finditer(line), best):
                parts += [line[at : m.start()], v]
                at = m.end()
            line = "".join(parts) + line[at:]
        fixed.append(line)
    return paragraphs(fixed), sorted(kinds)


def paragraphs(lines: list[str]) -> str:
    """Lines of one block run on; headings, list items and table rows stay lines."""
    width = max((len(x) for x in lines), default=0)
    blocks: list[str] = []
    open_ = False
    for x in lines:
        s = x.strip()
        if not s:
            open_ = False
            if blocks and blocks[-1] != "":
                blocks.append("")
            continue
        single = _single(s)
        if open_ and not single:
            blocks[-1] += " " + s
        else:
            blocks.append(s)
        open_ = not single and (len(s) >= 0.55 * width or s[-1] not in ".!?।॥۔؟。！？")
    return "\n".join(blocks).strip("\n")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            seen.update(_TOKEN.findall(t))
            seen.update(_SHAPE + shape(x) for x in t.replace("\f", "\n").split("\n") if has_form(x))
        if len(seen) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])
            seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])


def _pair_rows(seen: Counter) -> pa.RecordBatch:
    us, vs = zip(*seen) if seen else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array(vs, pa.string()), pa.array(list(seen.values()), pa.int64())], ["u", "v", "n"])


def _runs(t: str, n: int, into: Counter) -> None:
    for i in range(2, len(t)):
        into[t[i - 2 : i + 1]] += n
        into[t[i - 2 : i]] += n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shown: Counter = Counter()
    seen: Counter = Counter()

    def flush() -> None:
        for w, n in shown.items():
            t = f"\x02\x02{w}\x03"
            for i in range(2, len(t)):
                seen[t[i - 2 : i + 1]] += n
        shown.clear()

    for b in batches:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            shown[kinds_of(w)] += n
        if len(shown) > 200_000:
            flush()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["g", "n"])


def fit(texts: DataFrame) -> Model:
    """The model of a one-column table of texts: three aggregates over all of them."""
    sc = texts.sparkSession.sparkContext
    counted = cut_lineage(texts.mapInArrow(_count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    words = counted.where(~F.col("w").startswith(_SHAPE))
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // SHARE))
    frequent = {r.w: r.n for r in words.where(F.col("n") >= least).collect()}  # at most SHARE words
    shipped = sc.broadcast(frequent)
    forms = counted.where(F.col("w").startswith(_SHAPE) & (F.col("n") >= F.lit(max(1, total // SHARE))))
    shapes = {r.w[1:]: r.n for r in forms.collect()}  # at most SHARE shapes
    spelled = words.mapInArrow(_count_grams, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    grams = {r.g: r.n for r in spelled.where(F.col("n") >= least).collect()}  # runs of three kinds of characters, at most 10 * SHARE or so as words are short

    def confuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        index: dict[str, list[str]] = defaultdict(list)
        for w, n in own.items():
            if len(w) >= 3 and n >= RATIO and _SANE.match(w):
                for i in range(len(w)):
                    index[f"{w[:i]}\0{w[i + 1:]}"].append(w)
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(w) >= 3 and _SANE.match(w):
                    for i in range(len(w)):
                        for v in index.get(f"{w[:i]}\0{w[i + 1:]}", ()):
                            if v != w and own[v] >= RATIO * n and not (w[i].isupper() or v[i].isupper()) and w[i] not in _DASH:
                                rows.append((w[i], v[i], v, n))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.int64())], ["a", "b", "v", "n"])

    seen = words.mapInArrow(confuse, "a string, b string, v string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.countDistinct("v").alias("k"))
    learned = {(r.a, r.b): (r.n, r.k) for r in seen.where("k >= 3").collect()}  # pairs of characters
    confusions = channel(frequent, learned)
    rules, spelling = sc.broadcast(confusions), sc.broadcast(grams)
    rare = RATIO * least  # what is more frequent is no misreading, whatever it looks like

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shipped.value, {}, total, rules.value, None, spelling.value)
        for b in batches:
            rows = [(w, v, s) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for v, s in own.search(w) or (own.spell(w) if n <= rare else ())]
            ws, vs, ss = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(vs, pa.string()), pa.array(ss, pa.float64())], ["w", "v", "s"])

    index: dict[str, list[tuple[str, float]]] = {}
    for r in words.mapInArrow(look_up, "w string, v string, s double").collect():  # misread forms only
        index.setdefault(r.w, []).append((r.v, r.s))
    # a line is decoded between its ambiguous words: only pairs with a word that some form may stand for are asked for
    targets = sc.broadcast({v for options in index.values() for v, _ in options})

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, seen = shipped.value, targets.value, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for line in t.split("\n"):
                    ws = _TOKEN.findall(line)
                    if not asked.isdisjoint(ws):
                        seen.update([p for p in zip(ws, ws[1:]) if (p[0] in asked or p[1] in asked) and p[0] in own and p[1] in own])
            if len(seen) > 1_000_000:
                yield _pair_rows(seen)
                seen.clear()
        yield _pair_rows(seen)

    pairs = texts.mapInArrow(count_pairs, "u string, v string, n bigint").groupBy("u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pair_counts = {(r.u, r.v): r.n for r in pairs.collect()}  # at most SHARE pairs

    return Model(frequent, pair_counts, total, confusions, index, grams, shapes)


def channel(frequent: dict[str, int], learned: dict[tuple[str, str], tuple[int, int]]) -> dict[tuple[str, str], float]:
    """P(misread form | character): the fixed confusions and those that several words show,
    estimated by how often they were seen against how often the character was there."""
    letters: Counter = Counter()
    for w, n in frequent.items():
        for c in w:
            letters[c] += n
    out = {(a, b): 0.2 for a, b in CONFUSIONS.items()}
    top = Counter()
    for (a, _), (n, _) in learned.items():
        top[a] = max(top[a], n)
    for (a, b), (n, k) in learned.items():
        if (a, b) in out or (n >= 0.12 * top[a] and (k >= 4 or not a.isalpha() or n >= 6)):
            out[a, b] = min(0.5, max(out.get((a, b), 0.0), 0.02, 20 * n / max(letters[b], 1)))
    return out


def repaired(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row per row of df: (item_id, noise, text). noise is the sorted kinds among
    furniture, glyph and hyphen; text is the whole text as continuous paragraphs.

    Null, empty and blank texts come back as they are, without noise. Repeated rows are
    repeated. An empty table gives no rows. Other columns are not read.
    """
    kind = df.schema[item_id].dataType.simpleString()
    rows = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    model = fit(rows.where("text is not null").select("text"))
    shipped = df.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.total, model.confusions, model.index, model.grams, model.shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for b in batches:
            found = [repair(t, own) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for _, k in found], pa.list_(pa.string())), pa.array([t for t, _ in found], pa.string())], ["item_id", "noise", "text"])

    return spread(rows).mapInArrow(run, f"item_id {kind}, noise array<string>, text string")


def report(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "segments", "segment_id", "text_original"), "segment_id", "text_original").withColumnRenamed("item_id", "segment_id")


def found(spark, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).where("segment_id is not null").select("segment_id", F.explode("noise").alias("noise")).distinct()
