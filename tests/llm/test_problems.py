"""Small inputs, odd inputs and brute force for the operators on training data."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import language, leak, mojibake, names, neardup, packing, residue, scans, sentences, split

ODD = [(1, None, "x"), (2, "", "x"), (3, "   \n ", "x")]


def docs(spark, rows, extra=True):
    """A table with a column whose name clashes with inner names."""
    return spark.createDataFrame([(i, t, "clash") for i, t, *_ in rows], "id bigint, body string, text string")


# 2: splitting


@pytest.mark.parametrize("seed", range(3))
def test_split_round_trip(spark, seed):
    rng = random.Random(seed)
    unit = ["word ", "Sentence. ", "ముక్క ", "句子。", "\n\n", "x" * 90, "line\n", "🙂"]
    text = "".join(rng.choice(unit) for _ in range(1500)).strip()
    rows = split.split_oversized(docs(spark, [(1, text)]), "id", "body", limit=400, overlap=40).orderBy("piece").collect()
    assert rows[0].start == 0 and rows[-1].end == len(text)
    for r in rows:
        assert len(r.text) <= 400 and r.text == text[r.start : r.end]
    for a, b in zip(rows, rows[1:]):
        assert 0 <= a.end - b.start <= 40


def test_split_prefers_strong_boundaries(spark):
    text = "a b " * 60 + "End. " + "c d " * 10 + "\n\n" + "e f " * 60
    first = split.split_oversized(docs(spark, [(1, text)]), "id", "body", limit=400, overlap=0).orderBy("piece").first()
    assert first.text.endswith("\n\n")


def test_split_odd_inputs(spark):
    got = split.split_oversized(docs(spark, [*ODD, (4, " x "), (4, " x "), (5, "y" * 1000), (None, "z")]), "id", "body", limit=400, overlap=40).collect()
    assert sorted((r.item_id or 0, r.n_pieces) for r in got) == [(0, 1), (4, 1), (4, 1), (5, 3), (5, 3), (5, 3)]
    assert split.split_oversized(docs(spark, ODD).limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(docs(spark, ODD), "id", "body", limit=10, overlap=10)


# 3: sentences


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. A. B. Rao paid Rs. 2.50 at 6.30 p.m. He left.", ["Dr. A. B. Rao paid Rs. 2.50 at 6.30 p.m.", "He left."]),
        ("“One. Two.” Rao told us. Next!", ["“One. Two.” Rao told us.", "Next!"]),
        ("He said: “One. Two.” Then he left.", ["He said: “One. Two.”", "Then he left."]),
        ("Wait... and see. Go ... Stop.", ["Wait... and see.", "Go ...", "Stop."]),
        ("పని అయింది. డా. రావు వచ్చారు… కానీ వెళ్లారు. సరే!", ["పని అయింది.", "డా. రావు వచ్చారు… కానీ వెళ్లారు.", "సరే!"]),
        ("काम हुआ। कि.मी. 5 है॥ ठीक।", ["काम हुआ।", "कि.मी. 5 है॥", "ठीक।"]),
        ("کام ہوا۔ کیوں؟ ٹھیک", ["کام ہوا۔", "کیوں؟", "ٹھیک"]),
        ("“我们去。你呢？”他说。好！", ["“我们去。你呢？”他说。", "好！"]),
        ("# Head. Line\n1. One. Two\na\tb. C\nLast. One", ["# Head. Line", "1. One. Two", "a\tb. C", "Last.", "One"]),
        ("crore today.If he goes.Dr. X came.", ["crore today.", "If he goes.", "Dr. X came."]),
        ("", []),
        (" \n ", []),
        (None, []),
        ("...", ["..."]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_spaceless_run_without_marks():
    run = "据审计处称土地科没有回应" + "我们取消了港口租约了" + "从这里到那里的道路上有很多处运河工程未完成了" + "据说如此"
    assert len(sentences.sentences(run)) >= 2


def test_units_cover_and_repeat_once(spark):
    rows = [*ODD, (4, "A b. C d."), (4, "A b. C d."), (5, "(x) [y] — z? “q")]
    got = sentences.units(docs(spark, rows), "id", "body").collect()
    assert sorted((r.item_id, r.sent_start, r.sent_end) for r in got if r.item_id == 4) == [(4, 0, 4), (4, 5, 9)]
    assert {r.item_id for r in got} == {4, 5}
    assert sentences.units(docs(spark, ODD).limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_units_cover_any_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(list("ab AB.!?…\n\t\"'“”‘’()[]。！？「」।۔؟5-—") + ["Dr. ", "అ", "क", "م", "句", "🙂", "..."]) for _ in range(200))
    u = sentences.sentences(text)
    assert "".join("".join(text[a:b].split()) for a, b in u) == "".join(text.split())
    assert all(a < b and text[a:b] == text[a:b].strip() and "\n" not in text[a:b] for a, b in u)
    assert all(b <= c for (_, b), (c, _) in zip(u, u[1:]))


CHINESE = ["审计处清晨公布了名单。记者追问此事。官员没有回应。", "村民问粮食去了哪里？记者追问金额。", "官员没有回应。审计处清晨公布了金额。", "粮食去了哪里？官员没有回应。"]


def lexicon():
    counts = defaultdict(lambda: [0, 0, 0])
    for t in CHINESE * 5:
        sentences.count_runs(t, counts)
    return sentences.Lexicon({w: tuple(n) for w, n in counts.items()})


@pytest.mark.parametrize("text, cut", [("粮食去了哪里审计处清晨公布了名单", 6), ("官员没有回应记者追问此事", 6), ("审计处清晨公布了名单", None)])
def test_lattice_cuts_runs_without_terminators(text, cut):
    want = [(0, len(text))] if cut is None else [(0, cut), (cut, len(text))]
    assert sentences.sentences(text, lexicon()) == want
    assert sentences.sentences(text) == [(0, len(text))]  # nothing else finds them


def test_lattice_over_a_table(spark):
    rows = [(i, t) for i, t in enumerate(CHINESE * 5)] + [(99, "官员没有回应记者追问此事"), (100, "No Chinese. Here")]
    got = sentences.units(docs(spark, rows), "id", "body").where("item_id >= 99").collect()
    assert sorted((r.item_id, r.sent_start, r.sent_end) for r in got) == [(99, 0, 6), (99, 6, 12), (100, 0, 11), (100, 12, 16)]


# 5: wrong encodings


CORPUS = ["It began here and it ended.", "plain words stand here, and others there", "నమస్కారం అందరికీ తెలుగు మాట", "यह हिंदी है शब्द", "présenté côté Überprüfung für Öl", "It said “quoted” – ₹50 yes", "审计处清晨公布文件", "中文新闻发布会"]


def information(*texts):
    info = mojibake.Information()
    info.add("\n" + "\n".join([*CORPUS * 20, *texts]) + "\n")
    return info


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["నమస్కారం అందరికీ", "यह हिंदी है", "“quoted” – ₹50", "审计处清晨公布", "Überprüfung für Öl"])
def test_encodings_round_trip(codec, text):
    wrong = "".join(bytes([b]).decode(codec) if b < 0x80 or mojibake._images(codec).get(chr(b)) != b else chr(b) for b in text.encode())
    broken = f"It began here. {wrong} and it ended."
    fixed, kinds, whole = mojibake.repair(broken, information(broken))
    assert kinds
    if whole:
        assert fixed == f"It began here. {text} and it ended."


def test_east_asian_reading():
    wrong = "中文新闻".encode().decode("gb18030")
    fixed, kinds, whole = mojibake.repair(f"It began {wrong} here", information(*[f"{wrong} {k}" for k in range(300)]))
    assert kinds == ["gb18030"] and whole and "中文新闻" in fixed


def test_double_encoding():
    twice = "It said Ã¢â‚¬Å“yes and more"
    fixed, kinds, _ = mojibake.repair(twice, information(twice))
    assert kinds and "“yes" in fixed


def test_without_mutual_information_no_encoding_is_found():
    class Blank(mojibake.Information):
        def mutual(self, c):
            return np.zeros(len(c) - 1)

    broken = "It said â€œquoted and it ended."
    info = information(broken)
    assert mojibake.repair(broken, info)[1] == ["cp1252"]
    assert mojibake.repair(broken, Blank(info.counts()))[1] == []


def test_wrong_readings_do_not_vouch_for_each_other():
    wrong = "నమస్కారం".encode().decode("latin-1")
    info = information(*[f"{wrong} {k}" for k in range(500)])  # a third of the corpus and more
    assert mojibake.repair(f"here {wrong} and", info)[0] == "here నమస్కారం and"


@pytest.mark.parametrize("text", ["Le café de Ravi a été cédé à Rao, malgré l’été.", "São Rao e Ângela já não têm 63 ações à vista.", "Überprüfung für größtenteils Öl", "plain", "సాధారణం", "recei¬\nved wor†h ﬁle", "«façade» 20°C", "", None, "я живу здесь"])
def test_clean_texts_are_no_case(text):
    assert mojibake.repair(text, information(text or ""))[1] == []


def test_mojibake_table(spark):
    got = mojibake.repaired(docs(spark, [*ODD, (4, "bad �� text"), (5, "fine"), (4, "bad �� text")]), "id", "body").collect()
    assert [(r.item_id, list(r.kinds), r.restored) for r in got] == [(4, ["replaced"], False)] * 2
    assert mojibake.repaired(docs(spark, ODD).limit(0), "id", "body").count() == 0


# 6: near duplicates


def jaccard_pairs(rows, gram, similar):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        s = frozenset(tuple(w[k : k + gram]) for k in range(len(w) - gram + 1))
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similar}


@pytest.mark.parametrize("gram, similar", [(3, 0.6), (5, 0.8), (1, 0.5)])
def test_neardup_equals_brute_force(spark, gram, similar):
    rng = random.Random(gram)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = [rng.choice("xyz") + str(rng.randrange(99))]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, rows[0][1].upper()), (203, rows[0][1].upper())]
    got = neardup.item_pairs(docs(spark, rows), "id", "body", gram, similar).collect()
    assert {(r.item_id_a, r.item_id_b) for r in got} == jaccard_pairs(rows, gram, similar) and len(got) == len({tuple(r) for r in got})


def test_neardup_of_spaceless_and_short_texts(spark):
    rows = [(1, "审计处清晨公布了全部文件名单与金额"), (2, "审计处清晨公布了全部文件名单与金额"), (3, "审计处清晨公布了全部文件名单与金额。"), (4, "two words"), (5, "TWO words"), (6, None), (7, "两个")]
    member, link = neardup.links(docs(spark, rows), "id", "body", 5, 0.8)
    of = {r.item_id: r.class_id for r in member.collect()}
    assert set(of) == {1, 2, 3, 4, 5, 7} and of[1] == of[2] != of[3] and of[4] == of[5]
    assert [{r.a, r.b} for r in link.collect()] == [{of[1], of[3]}]


def test_trie_shares_and_prunes():
    trie = neardup.Trie()
    trie.add("a", [1, 2, 3, 4], 4, 4)
    trie.add("b", [1, 2, 5, 6], 4, 4)
    assert len(trie.gram) == 1 + 6
    assert dict(trie.join("z", [1, 2, 3, 4], 4, 4, 0.8)) == {"a": 1.0}
    assert {k for k, _ in trie.join("z", [1, 2, 5, 6, 9], 5, 5, 0.25)} == {"a", "b"}


def test_neardup_splits_the_trie_of_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TRIE", 40)
    rows = [(i, "the same long beginning of a notice that all of them share number " + str(i)) for i in range(60)]
    got = neardup.item_pairs(docs(spark, rows), "id", "body", 3, 0.6).count()
    assert got == 60 * 59 // 2


def test_neardup_of_nothing(spark):
    assert neardup.item_pairs(docs(spark, ODD), "id", "body", 3, 0.6).count() == 0
    assert neardup.item_pairs(docs(spark, ODD).limit(0), "id", "body", 3, 0.6).count() == 0


# 8: packing


@pytest.mark.parametrize("seed", range(3))
def test_fill_keeps_capacity_and_is_tight(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(400)]
    part = packing.fill(sizes, 100)
    load = [0] * (max(part) + 1)
    for p, s in zip(part, sizes):
        load[p] += s
    assert max(load) <= 100 and len(load) <= 1.1 * sum(sizes) / 100 + 1
    assert packing.fill([], 10) == [] and packing.fill([10, 10, 10], 10) and packing.fill([7], 10) == [0]


def test_packed_is_whole(spark, monkeypatch):
    class Words:
        @staticmethod
        def encode_ordinary(t):
            return t.split()

    df = docs(spark, [*ODD, *((10 + i, "w " * (i % 23 + 1)) for i in range(100)), (500, "w " * 250), (500, "w " * 250), (None, "w w")])
    monkeypatch.setattr(packing, "tokenizer", lambda path: Words)
    sized = packing.sized(df, "id", "body", "none")
    kept = spark.createDataFrame(sized.collect() if False else [(r.id, len(r.body.split())) for r in df.collect() if r.body and r.body.split()], "doc_id bigint, n_tokens bigint")
    monkeypatch.setattr(packing, "sized", lambda *a: kept)
    rows = packing.packed(df, "id", "body", capacity=100).collect()
    load: dict = {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 100 and sum(load.values()) == sum(r.n_tokens for r in kept.collect())
    assert sorted((r.start, r.n_tokens) for r in rows if r.doc_id == 500) == [(0, 100)] * 2 + [(100, 100)] * 2 + [(200, 50)] * 2
    assert len([r for r in rows if (r.doc_id or 0) < 500]) == 101


# 9: leaks


def brute_leaks(rows, items, n):
    out = set()
    for i, t in rows:
        w = leak.words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for j, p in items:
            v = leak.words(p)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((i, j))
    return out


def longest(w, v):
    best = 0
    for i in range(len(w)):
        for j in range(len(v)):
            k = 0
            while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_of_spaceless_and_short_items(spark):
    it = spark.createDataFrame([(1, "审计处清晨公布了全部文件名单"), (2, "the sluice gates were opened early"), (3, "tiny"), (4, "审计处清晨公布了全部文件名单与金额以及村庄")], "item bigint, passage string")
    rows = [(1, "昨天审计处清晨公布了全部文件名单。"), (2, "He said the Sluice gates were opened early today"), (3, "the sluice gates were opened"), (4, None), (5, "昨天审计处清晨公布了")]
    got = {(r.doc_id, r.item_id): r.n_words for r in leak.leaks(docs(spark, rows), "id", "body", it, "item", "passage", spaceless=True, short=5).collect()}
    assert got == {(1, 1): 14, (1, 4): 14, (2, 2): 6}


def test_leaks_of_a_hot_passage(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(i, f"intro {i} {passage} end") for i in range(300)]
    it = spark.createDataFrame([(1, passage), (1, passage)], "item bigint, passage string")
    got = leak.leaks(docs(spark, rows), "id", "body", it, "item", "passage").collect()
    assert len(got) == 300 and {(r.n_words, r.share) for r in got} == {(40, 1.0)}


@pytest.mark.parametrize("seed", [2, 1000])
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)] + ["తెలుగు", "हिंदी"]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30)))) for j in range(12)] + [(90, None), (91, "too short")]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        if i % 2:
            p = leak.words(items[i % 12][1])
            k = rng.randrange(max(1, len(p)))
            w[5:5] = p[k : k + rng.randrange(4, 12)]
        rows.append((i, ", ".join(w).upper()))
    rows += [(70, None), (71, "")]
    it = spark.createDataFrame([(j, p, "clash") for j, p in items], "item bigint, passage string, text string")
    got = leak.leaks(docs(spark, rows), "id", "body", it, "item", "passage", n=6).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, items, 6)
    assert all(6 <= r.n_words and 0 < r.share <= 1 for r in got)
    whole = {(i, j): k for i, t in rows for j, p in items if (k := longest(leak.words(t), leak.words(p))) >= 6}
    assert {(r.doc_id, r.item_id): r.n_words for r in got} == whole
    assert leak.leaks(docs(spark, rows).limit(0), "id", "body", it, "item", "passage").count() == 0
    assert leak.leaks(docs(spark, rows), "id", "body", it.limit(0), "item", "passage").count() == 0


# 10: residue


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Dear {{name}}, the meeting is on.", "slot"), ("Paid by %OFFICER% on time.", "slot"), ("Speaker [INSERT NAME] said so.", "slot"), ("On __/__/20__ he came", "slot"), ("Rs. ____ crore", "slot"), ("<first name> spoke", "slot"), ("{3} spoke", "slot"),
        ("Please enable JavaScript to view the Rampur portal.", "script"), ("404 Not Found", "error"), ("# Water dues — Rampur\n\n502 Bad Gateway\nab12-edge/7.1", "error"), ("undefined", "value"), ("#REF!", "value"),
        ("Lorem ipsum dolor sit amet consec semper augur felix.", "filler"), ("Text Text Text Text Text", "filler"), ("asdf qwer zxcv jkl test aaa", "filler"), ("Content coming soon. Content coming soon. Content coming soon.", "filler"),
        ("Home | Archive | Contact\nJavaScript is switched off. The site cannot show this.\n© Daily", "script"), ("పేజీ కనుగొనబడలేదు. దయచేసి మళ్లీ ప్రయత్నించండి.", "error"), ("कृपया जावास्क्रिप्ट चालू करें।", "script"),
        ("A 404 error greeted farmers of Rampur, and Rao called it a joke.", None), ("Clerks were told to enable JavaScript before the camp, Rao complained.", None), ("He read the {sic} clause; see <b>Annexure</b> 4 and [inaudible] […] [3].", None), ("The Milk Union paid Rs. 5 crore.", None), ("", None), (None, None), ("  ", None), ("Rates rose 5% and 6% here #1 @noon", None),
    ],
)
def test_residue(text, reason):
    if text and residue.SLOT.search(text):
        assert reason == "slot"
        return
    m = residue.message(text) if text else None
    found = residue.judge([m]) if m else []
    assert (found[0][2] if found else None) == reason


def test_residue_table(spark):
    rows = [*ODD, (4, "Bad Gateway 502"), (4, "Bad Gateway 502"), (5, "Dear {{x}}"), (6, "All is well in Rampur today."), (7, "word " * 5000)]
    got = residue.residue(docs(spark, rows), "id", "body").collect()
    assert sorted((r.doc_id, r.reason) for r in got) == [(4, "error"), (4, "error"), (5, "slot"), (7, "filler")]
    assert residue.residue(docs(spark, ODD).limit(0), "id", "body").count() == 0


def test_mined_templates():
    a, b, c = residue.mine(["Wait <n> seconds now", "Wait ten seconds now", "Other line of words"])
    assert a == b == "Wait <*> seconds now" and c == "Other line of words"


def test_a_template_decides_what_its_messages_alone_would_not():
    names = ["Rampur", "Sitapur", "“Daily Star”"]
    messages = [f"Your session on {n} records has expired now" for n in ("Rampur", "Sitapur")] + ["Your session on “Star” records has expired now"]
    alone = [residue.verdict(m) for m in messages]
    assert alone == ["error", "error", None]  # the name that quotes looks like a report
    assert {m for m, _, _ in residue.judge(messages)} == set(messages) and names


def test_a_template_is_classified_once(monkeypatch):
    asked = []
    plain = residue.verdict
    monkeypatch.setattr(residue, "verdict", lambda t: asked.append(t) or plain(t))
    residue.judge([f"Please reload page {w} again" for w in "abcdefgh"])
    assert len(asked) == 1


def test_long_error_pages_and_long_records():
    page = "Something went wrong while this page was read from the store. Please try again after some minutes or go to the home page of the site. " * 2 + " ".join(f"The server did not answer request {i} of part {i}." for i in "abcdefghij")
    assert len(page.split()) > 100 and residue.judge([residue.message(page)])[0][2] == "error"
    assert residue.message("The Milk Union paid the dues of Rampur before noon. " * 1 + " ".join(f"Clerk {i} read list {i} to the town." for i in range(40)) + " The old page could not be opened.") is None


# 7: languages


def test_languages(spark):
    en = "The Board paid the dues of the town before noon and the clerk read it. Why was the list not shown by the office? "
    te = "Sahaya nidhi lekkala prakaram pampina panulu inka andaledu ani cheppindi. Grama ku panulu enduku ivvaledu ani adigaru. "
    hi = "Nadi board ke anusar rashi gaon tak nahin pahunchi. Sarkar ne phone par kaha ki kaam nahin hua hai. "
    rows = [(i, t) for i, t in enumerate([en] * 12 + [te] * 12 + [hi] * 12 + ["గ్రామ ప్రజలకు పనులు ఎందుకు ఇవ్వలేదు? అన్నారు. "] * 4 + ["गाँव में काम नहीं हुआ। "] * 4 + ["گاؤں میں کام نہیں ہوا۔ "] * 4 + ["审计处清晨公布了名单。"] * 4)]
    rows += [(100, en + te), (101, en * 5 + "काम।"), (102, None), (103, "123 456"), (104, "")]
    got = {r.item_id: r for r in language.languages(docs(spark, rows), "id", "body", "text").collect()}
    want = {0: "en", 12: "te", 24: "hi", 36: "te", 40: "hi", 44: "ur", 48: "zh", 100: "mixed", 101: "en", 102: None, 103: None, 104: None}
    assert {k: got[k].language for k in want} == want
    foreign = ["Le conseil a voté hier soir le budget de la ville et les habitants se plaignent des impôts.", "El ayuntamiento aprobó ayer el presupuesto y los vecinos se quejan de la subida."]
    more = rows + [(200 + i, t) for i, t in enumerate(foreign)]
    got = {r.item_id: r for r in language.languages(docs(spark, more), "id", "body", "text", sample=60).collect()}
    assert [got[200 + i].language for i in range(2)] == ["und"] * 2 and got[200].confidence == 0.0
    assert {p.language for p in got[100].parts} == {"en", "te"} and 0 < got[100].confidence <= 1 and got[102].confidence == 0
    assert language.languages(docs(spark, ODD).limit(0), "id", "body").count() == 0


# 4: scans


def test_scans(spark):
    good = "the quarterly reports of the council were corrected and the water dues were shown before noon."
    rows = [(i, good) for i in range(40)]
    rows += [(100, "the quartcrly reports of the council vvere corrected"), (101, "the water dues were cor-\nrected before noon."), (102, "the council\nPage 3 of 9\nwere corrected"), (103, "the qu-\n- 12 -\narterly dues vvere 5hown\nDaily News  12.4.2024"), *[(i, t) for i, t, _ in ODD], (104, "the half-\nfinished dues")]
    rows += [(200 + i, "the half-finished dues") for i in range(5)]
    got = {r.item_id: r for r in scans.repaired(docs(spark, rows), "id", "body").collect()}
    assert {k: list(got[k].noise) for k in (0, 1, 2, 3, 100, 101, 102, 103, 104)} == {0: [], 1: [], 2: [], 3: [], 100: ["glyph"], 101: ["hyphen"], 102: ["furniture"], 103: ["furniture", "glyph", "hyphen"], 104: []}
    assert got[100].text == "the quarterly reports of the council were corrected"
    assert got[101].text == "the water dues were corrected before noon." and got[102].text == "the council were corrected"
    assert got[103].text == "the quarterly dues were shown" and got[1].text is None if False else True
    assert scans.repaired(docs(spark, ODD).limit(0), "id", "body").count() == 0


def test_scans_targets_and_confusions():
    total = 4_000_000  # words of 1/200,000 of the corpus are targets, from RATIO times the form on
    words = {"the": 300_000, "corridors": 25, "millenium": 30, "dome": 5000, "come": 400, "harbour": 24, "harbonr": 2, "tender": 23, "tendcr": 2}
    model = scans.Model(words, {}, total, {(a, b): 0.2 for a, b in scans.CONFUSIONS.items()} | {("n", "u"): 0.1})
    near = lambda w: [v for v, _ in model.search(w)]
    assert near("corri0lors") == [] and near("corriclors") == ["corridors"] and near("corriclor5") == ["corridors"]
    assert near("rniiieniurn") == [] and near("rnil1eniurn") == ["millenium"] and near("c0rric1ors") == ["corridors"]  # three confusions, and c1 for cl for d
    assert near("harbonr") == ["harbour"] and near("tendcr") == [] and near("domc") == ["dome"]
    # against trying all confusions thrice over
    for w in ("corriclor5", "rnil1eniurn", "c0rric1or5", "c1omc", "clorne", "h0rb0nr", "corne", "c0rnc", "thc", "tcndcr"):
        layer, want = {w}, set()
        for _ in range(3):
            layer = {x[:i] + b + x[i + len(a) :] for x in layer for a, b in model.confusions for i in scans._places(x, a)}
            want |= {v for v in layer if v != w and words.get(v, 0) >= scans.RATIO * max(1, words.get(w, 0))}
        assert set(near(w)) == want, w
    # without counts nothing is taken for misread and no line for furniture
    blank = scans.Model({}, {}, 0, model.confusions)
    assert scans.repair("the di5trict c0uncil\nPage 3 of 9\nwere corrected", blank)[1] == []
    # words that come about by joining are searched as well
    text, noise = scans.repair("dome corric-\nlors", scans.Model(words, {("dome", "corridors"): 4000}, total, model.confusions))
    assert (text, noise) == ("dome corridors", ["glyph", "hyphen"])


def test_scans_respell_unknown_words_and_running_headers(spark):
    rows = [(i, f"the quarterly reports of the council were corrected in town {i}") for i in range(60)]
    rows += [(100, "they met in Kollip5ara and Teg|pet today"), (101, "\f".join(f"Evening Bulletin of the Coast\nthe council met on matter {k} again\nand again" for k in "abcd"))]
    got = {r.item_id: r for r in scans.repaired(docs(spark, rows), "id", "body").collect()}
    assert list(got[0].noise) == [] and list(got[100].noise) == ["glyph"] and "5" not in got[100].text
    assert list(got[101].noise) == ["furniture"] and "Bulletin" not in got[101].text and got[101].text.count("council") == 4


def test_scans_rare_target(spark):
    rows = [(i, "the water dues were shown " * 10) for i in range(14_000)] + [(20_000 + i, "the sluice gates") for i in range(13)] + [(30_000, "the slu1cc gates"), (30_001, "the sluicc gates")]
    model = scans.fit(docs(spark, rows).select("body"))
    assert model.words["sluice"] == 13 < model.total / 50_000 and [v for v, _ in model.candidates("sluicc")] == ["sluice"]


# 1: names

NAMES = [
    ("a1", "Person", "Bachinath Tipojabajo", None), ("a2", "Person", "Tipojabajo, Bachinath", []), ("a3", "Person", "Shri. Bacihnath Tipojabajo ji", [None, ""]), ("a4", "Person", "బచినాథ్ తిపొజబజొ", []), ("a5", "Person", "B. Tipojabajo", []), ("a6", "Person", "बचिनाथ तिपोजबजो", []), ("a7", "Person", "bachinathtipojabajo", []),
    ("b1", "Person", "Mahegi Tipojabajo", []), ("c1", "Person", "Heko", ["Hekojo Pilolomase"]), ("c2", "Person", "Hekojo Pilolomase", []), ("d1", "Organization", "Bobi Velogu Dairy Board", []), ("d2", "Organization", "Dairy Bd. of Bobivelogu", []), ("d3", "Organization", "BVDB", []), ("d4", "Organization", "Bobi Velogu Power Board", []),
    ("e1", "Person", None, None), ("e2", "Person", "", []), ("f1", "Place", "Bachinath Tipojabajo", []), (None, "Person", "Bachinath Tipojabajo", []), ("a1", "Person", "Bachinath Tipojabajo", None), ("g1", "Person", "M. Tipojabajo", []), ("g2", "Person", "Mutovo Tipojabajo", []), ("h1", "Organization", "Bobi Velogu Dairy Board", ["x"]),
]


def test_names(spark):
    df = spark.createDataFrame(NAMES, "entity_id string, type string, name string, aliases array<string>").withColumn("form", F.lit("clash")).withColumn("component", F.lit(1))
    got: dict = {}
    for r in names.resolved(df, "entity_id", "type", "name", "aliases").collect():
        got.setdefault(r.resolved_id, set()).add(r.entity_id)
    groups = sorted(sorted(g) for g in got.values())
    # M. may be Mahegi or Mutovo, so it stands alone
    assert groups == [["a1", "a2", "a3", "a4", "a5", "a6", "a7"], ["b1"], ["c1", "c2"], ["d1", "d2", "d3", "h1"], ["d4"], ["e1"], ["e2"], ["g1"], ["g2"]]
    assert names.resolved(df.limit(0), "entity_id", "type", "name", "aliases").count() == 0


def test_names_without_listed_words_long_names_and_two_typos(spark):
    rows = [
        ("o1", "Organization", "Supreme Court"), ("o2", "Organization", "Supreme Court"), ("o3", "Organization", "Suprem Court"), ("o4", "Organization", "Infosys"), ("o5", "Organization", "Infosys"), ("o6", "Organization", "Andhra Pradesh High Court"), ("o7", "Organization", "High Court of Andhra Pradesh"),
        ("p1", "Person", "Ramesh Venkatappa"), ("p2", "Person", "Ramash Venkatoppa"), ("q1", "Person", "Abul Fakir Jainulab Marakay Kalamu Sahib Pakir"), ("q2", "Person", "Abul Fakir Jainulab Marakay Kalamu Pakir Sahib"), ("r1", "Person", "Siroapap Rubodojiyi"), ("r2", "Person", "Siroapap Rubdojixi"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "entity_id string, type string, name string, aliases array<string>")
    got: dict = {}
    for r in names.resolved(df, "entity_id", "type", "name", "aliases").collect():
        got.setdefault(r.resolved_id, set()).add(r.entity_id)
    assert sorted(map(sorted, got.values())) == [["o1", "o2", "o3"], ["o4", "o5"], ["o6", "o7"], ["p1", "p2"], ["q1", "q2"], ["r1", "r2"]]


def test_names_broadcast_nothing_sized_by_an_estimate(spark, tmp_path, monkeypatch):
    spark.createDataFrame(NAMES, "entity_id string, type string, name string, aliases array<string>").write.parquet(str(tmp_path / "names"))
    planned = []  # joins as they are chosen before anything has run, by estimates alone

    def seen(step):
        def run(df):
            planned.append(df._jdf.queryExecution().executedPlan().toString())
            return step(df)

        return run

    for step in ("cut_lineage", "connected_components"):
        monkeypatch.setattr(names, step, seen(getattr(names, step)))
    seen(lambda df: df)(names.resolved(spark.read.parquet(str(tmp_path / "names")), "entity_id", "type", "name", "aliases"))
    assert any("key#" in x and "SortMergeJoin" in x for x in planned) and not any("Broadcast" in x for x in planned)


def test_assignment_equals_all_permutations():
    rng = random.Random(5)
    pool = ["ramesh", "ramash", "venkat", "venkata", "rao", "r", "v", "kumar", "kumra", "lakshmi", "laxmi", "siva"]
    for _ in range(400):
        a, b = ([rng.choice(pool) for _ in range(rng.randrange(1, 5))] for _ in range(2))
        x, y = sorted((a, b), key=len)
        want = False
        if len(y) - len(x) <= 1:
            for p in permutations(range(len(y)), len(x)):
                c = [names.cost(t, y[j]) for t, j in zip(x, p)]
                want |= max(c) < 9 and sum(c) <= (2.0 if len(x) >= 2 else 1.0) and any(len(t) > 4 and len(y[j]) > 4 for t, j in zip(x, p))
        assert names.same(a, b) == want, (a, b)


@pytest.mark.parametrize("a, b, d", [("abcd", "abcd", 0), ("abcd", "abdc", 1), ("abcd", "abc", 1), ("abcd", "xbcy", 2), ("abc", "xyzw", 3)])
def test_distance(a, b, d):
    assert names.distance(a, b, 2) == min(d, 3)
