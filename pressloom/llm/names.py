"""Problem 1: rows that name one person or organisation in different spellings.

Every spelling of a row is reduced to a form: tokens in Latin letters without honorifics,
long vowels, aspiration and doubled letters; an organisation's words are its place, field
and kind, with abbreviations written out. Rows of one form meet at once. Different forms
meet in a symmetric-delete index on pairs of tokens, each with a character left out, or one
of them with two if it is long: the index reaches as far as the verification accepts, and a
family name alone brings nobody together. Candidates are verified by the optimal assignment
of their tokens, of any number. Initials, nicknames and acronyms are placed afterwards, and only where one single
entity of all fits; that is decided by two aggregates for each key, not by pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators.components import connected_components
from pressloom.session import cut_lineage
from pressloom.sources.tables import table

PERSON, ORGANIZATION = "Person", "Organization"
#: Fixed words around names.
HONORIFICS = frozenset("shri sri shree smt srimati dr adv hon mr mrs ms prof er late kumari garu gaaru ji anna akka sir madam saheb sahib శ్రీ శ్రీమతి డా గారు అన్న श्री श्रीमती डॉ डा जी".split())
NICK_ENDINGS = ("ji", "bbu", "nny", "bby", "ttu", "nnu", "chi", "lu")
KINDS = "board trust limited corporation society agency authority federation company council commission department union bank association foundation institute committee cooperative directorate mission".split()
FIELDS = "power minerals dairy fisheries housing irrigation textile transport development education health water agriculture ports roads tourism forest sugar seeds milk handloom energy electricity industries welfare finance".split()
#: Fixed translations and short forms of such words.
WORDS = {
    "ltd": "limited", "corp": "corporation", "corpn": "corporation", "co": "company", "bd": "board", "brd": "board", "agy": "agency", "auth": "authority", "fedn": "federation", "fed": "federation", "soc": "society", "tr": "trust", "trst": "trust", "dept": "department", "assn": "association", "pwr": "power", "min": "minerals", "hsg": "housing", "tex": "textile", "irrig": "irrigation", "irr": "irrigation", "fish": "fisheries", "dev": "development", "devp": "development", "devt": "development", "socy": "society", "tpt": "transport", "edn": "education", "edu": "education", "educ": "education", "trans": "transport", "transp": "transport", "dy": "dairy", "agri": "agriculture", "fndn": "foundation", "inst": "institute",
    "బోర్డు": "board", "ట్రస్టు": "trust", "ట్రస్ట్": "trust", "లిమిటెడ్": "limited", "కార్పొరేషన్": "corporation", "సొసైటీ": "society", "ఏజెన్సీ": "agency", "అథారిటీ": "authority", "ఫెడరేషన్": "federation", "సమాఖ్య": "federation", "విద్యుత్": "power", "ఖనిజ": "minerals", "డెయిరీ": "dairy", "పాడి": "dairy", "పాల": "dairy", "మత్స్య": "fisheries", "మత్స్యకార": "fisheries", "గృహ": "housing", "నీటిపారుదల": "irrigation", "చేనేత": "textile", "జౌళి": "textile", "వస్త్ర": "textile", "రవాణా": "transport", "అభివృద్ధి": "development", "విద్య": "education", "విద్యా": "education", "నిర్మాణ": "", "ప్రాధికార": "authority", "ప్రాధికారసంస్థ": "authority", "సంస్థ": "",
    "बोर्ड": "board", "ट्रस्ट": "trust", "न्यास": "trust", "लिमिटेड": "limited", "निगम": "corporation", "सोसायटी": "society", "समिति": "society", "एजेंसी": "agency", "प्राधिकरण": "authority", "महासंघ": "federation", "संघ": "federation", "विद्युत": "power", "बिजली": "power", "खनिज": "minerals", "डेयरी": "dairy", "दुग्ध": "dairy", "मत्स्य": "fisheries", "आवास": "housing", "गृह": "housing", "निर्माण": "", "सिंचाई": "irrigation", "वस्त्र": "textile", "परिवहन": "transport", "विकास": "development", "शिक्षा": "education", "the": "", "of": "", "and": "", "for": "",
}

_CONSONANTS = dict(zip("కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరలవశషసహళఱ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l r".split()))
_CONSONANTS |= dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split()))
_SIGNS = dict(zip("ాిీుూృెేైొోౌ", "a i i u u r e e ai o o au".split())) | dict(zip("ािीुूृेैोौॆॊॅॉ", "a i i u u r e ai o au e o e o".split()))
_VOWELS = dict(zip("అఆఇఈఉఊఎఏఐఒఓఔ", "a a i i u u e e ai o o au".split())) | dict(zip("अआइईउऊएऐओऔ", "a a i i u u e ai o au".split()))


def latin(word: str) -> str:
    """Telugu and Devanagari letters in Latin ones, everything else as it is."""
    out: list[str] = []
    open_ = False  # a consonant that still has its own vowel
    for c in word:
        if c in _CONSONANTS:
            out += ["a"] * open_ + [_CONSONANTS[c]]
            open_ = True
        elif c in _SIGNS:
            out.append(_SIGNS[c])
            open_ = False
        elif c in "్्":
            open_ = False
        elif c in "ంँं":
            out += ["a"] * open_ + ["n"]
            open_ = False
        elif c in "़‌‍ః":
            continue
        else:
            out += ["a"] * open_ + [_VOWELS.get(c, c)]
            open_ = False
    return "".join(out) + "a" * open_


_SOUNDS = [(re.compile(a), b) for a, b in (("aa+", "a"), ("ee+", "i"), ("ii+", "i"), ("oo+", "u"), ("uu+", "u"), ("chh", "ch"), (r"([bdgjkpst])h", r"\1"), ("w", "v"), ("z", "j"), (r"(.)\1+", r"\1"), ("m(?=[bp])", "n"), ("h$", ""), ("avu$", "ao"), ("(?<=.{3})a$", ""), ("(?<=.)av$", "ao"))]


def skeleton(word: str) -> str:
    """A word without the differences that spelling it by ear makes."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)) if word.isascii() is False and not any(ord(c) > 0x8FF for c in word) else word
    w = re.sub(r"[^a-z]", "", latin(w.lower()).lower())
    for pattern, to in _SOUNDS:
        w = pattern.sub(to, w)
    return w


_SPLIT = re.compile(r"[\s.,()\-–/&]+")


def literal(word: str) -> str:
    """A word as it is typed, in Latin letters; typos may look like long vowels."""
    return re.sub(r"[^a-z]", "", latin(word.lower()).lower())


def person(name: str, reading=skeleton) -> tuple[str, list[str]]:
    """(kind, tokens): kind is full, initial, single or none; tokens in their order."""
    tokens = []
    for raw in _SPLIT.split(unicodedata.normalize("NFKC", name)):
        low = raw.lower()
        if not raw or low in HONORIFICS:
            continue
        if len(raw) == 1 and raw.isascii():
            tokens.append(low)
        elif s := reading(raw):
            tokens.append(s)
    long_ = [t for t in tokens if len(t) > 1]
    if not tokens:
        return "none", []
    if not long_ or (len(long_) == 1 and len(tokens) == 1):
        return "single", tokens
    return ("full" if len(long_) > 1 else "initial"), tokens


def _within(short: str, word: str) -> bool:
    """Whether the letters of a short form stand in a word in their order."""
    rest = iter(word)
    return short[0] == word[0] and all(c in rest for c in short)


def _generic(token: str, short: bool) -> list[str]:
    """The field or kind words a token may stand for; short forms end with a period."""
    if token in KINDS or token in FIELDS:
        return [token]
    if token in WORDS:
        return [WORDS[token]]
    if short and len(token) > 1:
        fits = [w for w in [*KINDS, *FIELDS] if _within(token, w)]
        return sorted(fits, key=lambda w: (not w.startswith(token), len(w)))[:1]
    if len(token) >= 5:
        near = [w for w in [*KINDS, *FIELDS] if abs(len(w) - len(token)) <= 1 and w[0] == token[0] and distance(w, token, 1) <= 1]
        if near:
            return near[:1]
    return []


def organization(name: str) -> tuple[str, list[str]]:
    """(kind, [place, field, kind]), or (acronym, [letters])."""
    marked = re.findall(r"([^\s.,()\-–/&]+)(\.?)", unicodedata.normalize("NFKC", name))
    raw = [t for t, _ in marked]
    if len(raw) == 1 and raw[0].isascii() and raw[0].isupper() and 2 <= len(raw[0]) <= 6:
        return "acronym", [raw[0].lower()]
    place, field, kind = [], "", ""
    for t, dot in marked:
        g = _generic(t.lower(), bool(dot))
        if g == [""]:
            continue
        if g and g[0] in KINDS and not kind:
            kind = g[0]
        elif g and g[0] in FIELDS and not field:
            field = g[0]
        elif t.lower() == "tr" and not field:
            field = "transport"
        else:
            place.append(t)
    letters = "".join(skeleton(t)[:1] for t in place) + field[:1] + kind[:1]
    joined = skeleton("".join(latin(t.lower()) for t in place))
    if not joined:
        return "single", [joined]
    if not (field or kind):  # no listed word: all its words, in any order
        return "full", [skeleton("".join(sorted(latin(t.lower()) for t in place))), "", "", letters]
    return "full", [joined, field, kind, letters]


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 when above most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, old = row, [i], before
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if old is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, old[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


def cost(a: str, b: str) -> float:
    """Cost of aligning two tokens; 9 is no alignment."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 9.0
    short = min(len(a), len(b))
    if short < 4:
        return 9.0
    d = distance(a, b, 2 if short >= 8 else 1)
    if d > (2 if short >= 8 else 1):
        return 9.0
    if short == 4 and len(a) == len(b) and sorted(a) != sorted(b):
        return 9.0
    return float(d)


def same(a: list[str], b: list[str]) -> bool:
    """Whether two persons' tokens align: every token of the shorter with another of the
    longer, one of them long and near, at most one middle name left over."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    most = 2.0 if len(a) >= 2 else 1.0
    # optimal assignment: the least cost for every set of tokens taken, without and with a long pair
    states: dict[tuple[int, bool], float] = {(0, False): 0.0}
    for x in a:
        row = [cost(x, y) for y in b]
        nxt: dict[tuple[int, bool], float] = {}
        for (taken, long_), c in states.items():
            for j, y in enumerate(b):
                if not taken >> j & 1 and row[j] < 9 and c + row[j] <= most:  # few ways stay this cheap
                    key = (taken | 1 << j, long_ or (len(x) > 4 and len(y) > 4))
                    if c + row[j] < nxt.get(key, 99.0):
                        nxt[key] = c + row[j]
        states = nxt
        if not states:
            return False
    return any(long_ for _, long_ in states)


def _deletes(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 3 else {w}


def _two_deletes(w: str) -> set[str]:
    return {w[:i] + w[i + 1 : j] + w[j + 1 :] for i, j in combinations(range(len(w)), 2)}


def person_keys(tokens: list[str], wide: bool = True) -> set[str]:
    """Keys under which a full name meets others: the name written as one word, and each pair
    of tokens with a character left out of one of the two; with ``wide`` of both, or two out
    of a token of 8 and more characters."""
    long_ = [t for t in tokens if len(t) > 1]
    keys = set()
    for order in (long_, long_[::-1], long_[1:] + long_[:1], long_[-1:] + long_[:-1]):
        keys.add("c " + re.sub(r"(.)\1+", r"\1", "".join(order)))
    for i, j in combinations(range(len(long_)), 2):
        a, b = sorted((long_[i], long_[j]))
        if max(len(a), len(b)) < 5:
            continue
        da, db = _deletes(a), _deletes(b)
        made = [(x, y) for x in da for y in db] if wide else [(x, b) for x in da] + [(a, y) for y in db]
        if wide and len(a) >= 8:
            made += [(x, b) for x in _two_deletes(a)]
        if wide and len(b) >= 8:
            made += [(a, y) for y in _two_deletes(b)]
        keys.update(f"p {x} {y}" if x < y else f"p {y} {x}" for x, y in made)
    return keys


_FORM = "entity_id string, type string, own boolean, form string, kind string, tokens array<string>, typed array<string>"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for e, t, name, aliases in zip(*(b.column(i).to_pylist() for i in range(4))):
            for k, spelling in enumerate([name, *(aliases or [])]):
                if not spelling:
                    continue
                kind, tokens = (person if t == PERSON else organization)(spelling)
                if tokens and tokens[0]:
                    shown = " ".join(sorted(tokens)) if t == PERSON else " ".join(tokens[:3])
                    typed = person(spelling, literal)[1] if t == PERSON else tokens
                    rows.append((e, t, k == 0, f"{t[0]}|{kind}|{shown}", kind, tokens, typed))
        cols = list(zip(*rows)) or [()] * 7
        types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["entity_id", "type", "own", "form", "kind", "tokens", "typed"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id): hashes of the keys of every form, with its own."""
    for b in batches:
        keys, ids, counts = [], [], []
        for i, t, tokens, typed in zip(*(b.column(i).to_pylist() for i in range(4))):
            if t == PERSON:
                own = person_keys(tokens) | {f"t{k}" for k in person_keys(typed, False)}
            else:
                place, field, kind = tokens[:3]
                own = {f"o {x} {field} {kind}" for x in _deletes(place) | (_two_deletes(place) if len(place) >= 10 else set())}
            keys += [xxhash.xxh64_intdigest(k) - (1 << 63) for k in own]
            ids.append(i)
            counts.append(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.repeat(np.array(ids, np.int64), np.array(counts, np.int64)))], ["key", "id"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, list] = ([], [])
        for x, y, tx, ty, lx, ly in zip(*(b.column(i).to_pylist() for i in range(6))):
            if x[0] == "P":
                joined = any(re.sub(r"(.)\1+", r"\1", "".join(p)) == re.sub(r"(.)\1+", r"\1", "".join(q)) for p in (tx, tx[::-1], tx[1:] + tx[:1], tx[-1:] + tx[:-1]) for q in (ty,))
                ok = same(tx, ty) or same(lx, ly) or joined
            else:
                ok = tx[1:3] == ty[1:3] and distance(tx[0], ty[0], 2) <= (2 if min(len(tx[0]), len(ty[0])) >= 10 else 1)
            if ok:
                out[0].append(x)
                out[1].append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["x", "y"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, key, asks): keys that full names answer to, and keys that initials,
    nicknames and acronyms ask for, best first by rank."""
    for b in batches:
        rows = []
        for comp, t, kind, tokens in zip(*(b.column(i).to_pylist() for i in range(4))):
            if t == ORGANIZATION:
                if kind == "full" and len(tokens) > 3:
                    rows.append((comp, f"a {tokens[3]}", False, 0))
                elif kind == "acronym":
                    rows.append((comp, f"a {tokens[0]}", True, 0))
                continue
            long_ = [x for x in tokens if len(x) > 1]
            if kind == "full":
                for a in long_:
                    rest = [x for x in tokens if x != a] or [a]
                    firsts = sorted(x[0] for x in rest)
                    if len(a) > 4:
                        for letters in {"".join(firsts), *(x for x in firsts)}:
                            rows += [(comp, f"i{0 if v == a else 1} {v} {letters}", False, 0) for v in _deletes(a)]
                        for x in rest:
                            if len(x) > 2:
                                rows += [(comp, f"n {a} {x[:k]}", False, 0) for k in range(3, len(x))]
                                rows.append((comp, f"d {a} {x[:2]}", False, 0))
                for x in long_:  # a nickname looks for the name it is short for
                    for a in long_:
                        if a != x and len(a) > 4 and len(long_) == 2:
                            if 3 <= len(x) <= 5:
                                rows.append((comp, f"n {a} {x}", True, 2))
                            if any(x.endswith(skeleton(s)) and len(x) <= len(s) + 2 for s in NICK_ENDINGS):
                                rows.append((comp, f"d {a} {x[:2]}", True, 3))
                    if len(x) > 5:
                        rows.append((comp, f"s {x}", False, 0))
            elif kind == "single":
                if long_ and len(long_[0]) > 5:
                    rows.append((comp, f"s {long_[0]}", True, 4))
            elif kind == "initial":
                a = long_[0]
                letters = "".join(sorted(x for x in tokens if len(x) == 1))
                rows.append((comp, f"i0 {a} {letters}", True, 0))
                if len(a) > 5:
                    rows += [(comp, f"i1 {v} {letters}", True, 1) for v in _deletes(a) if v != a] + [(comp, f"i0 {v} {letters}", True, 1) for v in _deletes(a) if v != a] + [(comp, f"i1 {a} {letters}", True, 1)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int32())], ["component", "key", "asks", "rank"])


def _by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join that is never broadcast. The optimizer sizes what comes out of an Arrow
    function, or out of compressed files, by what goes in: the keys of a form, over a hundred,
    count as one row, and would be collected on the driver."""
    return df.hint("merge")


def _placed(forms: DataFrame, component: DataFrame, initials: bool) -> DataFrame:
    """(src, dst): components that only one other component can stand for, by initials and
    single tokens or else by nicknames and acronyms."""
    known = _by_shuffle(forms.where("own or kind = 'full'")).join(component.withColumnRenamed("node", "entity_id"), "entity_id")
    rows = cut_lineage(known.select("component", "type", "kind", "tokens").distinct().mapInArrow(_pieces, "component string, key string, asks boolean, rank int").distinct())
    answers = rows.where("not asks").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    short = F.substring("key", 1, 1).isin("i", "s")
    asked = rows.where(F.col("asks") & (short if initials else ~short)).join(answers, "key")
    # whoever already stands in the answer is told apart from others by leaving itself out
    other = asked.where("lo <> component or hi <> component").withColumn("lo", F.when(F.col("lo") == F.col("component"), F.col("hi")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(F.col("hi") == F.col("component"), F.col("lo")).otherwise(F.col("hi"))
    )
    tiers = other.groupBy("component", "rank").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = tiers.groupBy("component").agg(F.min_by(F.struct("lo", "hi"), "rank").alias("t"))
    return first.where("t.lo = t.hi").select(F.col("component").alias("src"), F.col("t.lo").alias("dst"))


def resolved(entities: DataFrame, entity_id: str, kind: str, name: str, aliases: str) -> DataFrame:
    """(entity_id, type, resolved_id): rows of one person or organisation share resolved_id.

    Only rows of the types Person and Organization with an id are returned; types never
    mix. A null or blank name counts through its aliases alone; null, empty and blank
    aliases are passed over; a row without any usable spelling stands alone. Repeated rows
    give one row. Names of one token link by their
    aliases, or where a single entity has that token. An empty table gives no
    rows. Other columns are not read.
    """
    rows = entities.select(F.col(entity_id).alias("entity_id"), F.col(kind).alias("type"), F.col(name).alias("name"), F.col(aliases).alias("aliases")).where(
        F.col("type").isin(PERSON, ORGANIZATION) & F.col("entity_id").isNotNull()
    )
    forms = cut_lineage(rows.mapInArrow(_forms, _FORM).distinct())
    full = forms.where("kind = 'full' or (type = 'Person' and kind = 'single' and length(tokens[0]) >= 9)").select("form", "type", "tokens", "typed").distinct()
    full = full.withColumn("id", F.xxhash64("form"))
    keys = full.select("id", "type", "tokens", "typed").mapInArrow(_keys, "key bigint, id bigint").distinct()
    near = _by_shuffle(keys.select("key", F.col("id").alias("x"))).join(keys.select("key", F.col("id").alias("y")), "key").where("x < y").select("x", "y").distinct()
    spelled = lambda c: _by_shuffle(full.select(F.col("id").alias(c), F.col("form").alias(f"f{c}"), F.col("tokens").alias(f"t{c}"), F.col("typed").alias(f"l{c}")))
    pairs = near.join(spelled("x"), "x").join(spelled("y"), "y")
    alike = pairs.select(F.col("fx").alias("x"), F.col("fy").alias("y"), "tx", "ty", "lx", "ly").mapInArrow(_verify, "x string, y string").distinct()
    # forms of initials and acronyms bring together only the rows that are written so
    held = forms.where("kind = 'full' or (own and kind in ('initial', 'acronym')) or (type = 'Person' and kind = 'single' and length(tokens[0]) >= 9)")
    edges = held.select(F.col("entity_id").alias("src"), F.col("form").alias("dst")).unionByName(alike.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    alone = rows.select(F.col("entity_id").alias("src"), F.col("entity_id").alias("dst"))
    component = cut_lineage(connected_components(edges.unionByName(alone)))
    # nicknames first, so that initials meet whole entities
    for initials in (False, True):
        placed = _placed(forms, component, initials)
        joined = connected_components(placed.unionByName(component.select(F.col("component").alias("src"), F.col("component").alias("dst")).distinct()))
        component = cut_lineage(component.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component").select("node", F.col("whole").alias("component")))
    final = component.withColumnsRenamed({"node": "entity_id", "component": "resolved_id"})
    return _by_shuffle(rows.select("entity_id", "type").distinct()).join(final, "entity_id").withColumn("resolved_id", F.concat_ws(":", "type", F.sha1("resolved_id")))


def groups(spark, sf_dir: str) -> DataFrame:
    return resolved(table(spark, sf_dir, "entities", "entity_id", "type", "name", "aliases"), "entity_id", "type", "name", "aliases")


def found(spark, sf_dir: str) -> DataFrame:
    member = cut_lineage(groups(spark, sf_dir))
    a = member.select("resolved_id", F.col("entity_id").alias("entity_id_a"))
    b = member.select("resolved_id", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "resolved_id").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()
