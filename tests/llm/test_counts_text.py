"""Term counts, contamination, mixing and languages on small inputs, with brute force and edge cases."""

import random
from collections import Counter

import pytest

from chandas.llm import contamination, langid, mixing, terms


def test_ngrams_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    docs = [(i, [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]) for i in range(200)]
    docs += [(500, ["a"] * 2000), (501, None), (502, ["a", None, "b"])]
    rows = [("s", i, t, [1] * len(t or []), "x") for i, t in docs] + [("s", 0, docs[0][1], [1] * len(docs[0][1]), "x"), ("s", None, ["a"], [1], "x")]
    df = spark.createDataFrame(rows, "term_set string, record long, terms array<string>, weights array<long>, ngram string").repartition(3)
    cf, holders = Counter(), {}
    for i, t in docs + [docs[0]]:
        t = [x for x in t or [] if x]
        for p in range(len(t)):
            for n in (1, 2, 3):
                if p + n <= len(t):
                    g = tuple(t[p : p + n])
                    cf[g] += 1
                    holders.setdefault(g, set()).add(i)
    want = {g: (n, len(holders[g])) for g, n in cf.items()}
    assert {tuple(r.ngram): (r.cf, r.df) for r in terms.ngram_counts(df, 3).collect()} == want
    # many splits and small chunks give the same
    monkeypatch.setattr(terms, "SPLIT_RECORDS", 20)
    monkeypatch.setattr(terms, "CHUNK", 30)
    assert {tuple(r.ngram): (r.cf, r.df) for r in terms.ngram_counts(df, 3).collect()} == want
    assert terms.ngram_counts(df.limit(0), 3).count() == 0


def test_verdicts(spark):
    c = spark.createDataFrame([("s", "r", 9, 3), ("s", "c", 99, 95), ("s", "u", 9, 90)], "term_set string, term string, cf long, df long")
    t = spark.createDataFrame([("s", 100)], "term_set string, records long")
    assert {r.term: r.verdict for r in terms.verdicts(c, t).collect()} == {"r": "rare", "c": "common", "u": "useful"}


ITEM = "the quick brown fox jumps over the lazy dog near old mill pond today"


def test_contamination(spark):
    w = ITEM.split()
    docs = [
        (1, "x x x x " + " ".join(w[:10]).upper() + " y y y y"), (2, " ".join(w[:9]) + " z"), (3, "-- " + "\n> ".join(w[2:13]) + "."), (4, None), (5, ""), (6, "the quick" + "​" + " brown “fox” jumps—over the lazy dog near " * 2),
        (7, "word " * 50_000 + ITEM), (8, "ｔｈｅ quick br­own fox; jumps over, the lazy dog (near) old!"), (9, "a̱gnim ī̍ḻe " + "वा॑ चि॒द् " * 6),
    ]
    items = [(1, ITEM), (2, ITEM + " and more"), (3, "too short"), (4, None), (5, ""), (6, "agnim īḻe " + "वा चिद् " * 5)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in contamination.leaks(d, i).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (3, 2), (6, 1), (6, 2), (7, 1), (7, 2), (8, 1), (8, 2), (9, 6)}
    assert contamination.leaks(d, i.limit(0)).count() == 0 and contamination.leaks(d.limit(0), i).count() == 0
    c = {r.doc_id: r for r in contamination.clean(d, i).collect()}
    assert c[1].dropped is False and c[1].clean_text == "x x x x  y y y y" and c[3].dropped and c[4].clean_text is None and c[2].removed_chars == 0
    assert c[7].clean_text.startswith("word word") and "jumps" not in c[7].clean_text


def test_cleaning_does_not_depend_on_blocks(spark, monkeypatch):
    w = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(w[:20])), (2, " ".join(w[15:33])), (3, " ".join(w[40:52])), (4, " ".join(w[10:15] + w[52:60]))], "item_id long, item_text string")
    docs = [
        (1, " ".join(w[:33] + ["x"] * 3)), (2, " ".join(["x"] * 30 + w[:33] + ["y"] * 30)), (3, " ".join(w[5:15] + w[40:52] + w[52:60] + ["z"] * 20)),
        (4, " ".join(["x"] * 20 + w[10:15] + w[40:52] + w[52:60] + ["z"] * 20)), (5, None), (6, ""), (7, "plain " * 20),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole, leaked = sorted(map(tuple, contamination.clean(d, items).collect())), sorted(map(tuple, contamination.leaks(d, items).collect()))
    monkeypatch.setattr(contamination, "MAX_BLOCK_WORDS", 1)
    monkeypatch.setattr(contamination, "GROUP_CHARS", 1)
    assert len(contamination._blocks(items, 10)) == 4
    assert sorted(map(tuple, contamination.leaks(d, items).collect())) == leaked
    assert sorted(map(tuple, contamination.clean(d, items).collect())) == whole
    r = {x[0]: x for x in whole}
    assert r[1][4] and abs(r[1][3] - 33 / 36) < 1e-9 and r[2][1] == " ".join(["x"] * 30) + "  " + " ".join(["y"] * 30)
    # where the middle is cut, what stood around it doesn't become a passage
    assert r[4][1] == " ".join(["x"] * 20 + w[10:15]) + "  " + " ".join(w[52:60] + ["z"] * 20)


def test_places_are_those_of_the_words():
    rnd = random.Random(8)
    pool = ["a", "B", "é", "e", "\u0301", "\u200b", "\u0951", " ", "\u00a0", "\n", "-", "…", "ﬁ", "Ｑ", "ｶ", "ﾞ", "কো", "ে", "া", "क", "्", "़", "한", "\u1112", "\u1161", "\u11ab", "\u3164", "ß", "İ", "।", "’", "½"]
    for _ in range(3000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        got = contamination._offsets(t)
        assert [w for w, _, _ in got] == contamination.words(t), repr(t)
        assert all(a < z for _, a, z in got) and all(x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_automaton_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(30):
        items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(3, 30)))) for i in range(6)]
        auto, k = contamination.Automaton(items, 4), 4
        doc = [rnd.choice("abcd") for _ in range(60)]
        want = set()
        for p in range(len(doc) - k + 1):
            for i, t in items:
                s = t.split()
                if any(s[q : q + k] == doc[p : p + k] for q in range(len(s) - k + 1)):
                    want.add((p + k, i))
        assert {(e, i) for e, _, v in auto.stream(doc) for i in auto.owners[auto.at_k[v]]} == want


@pytest.fixture(scope="module")
def mix(spark):
    rows = [(i, "Big-Source " if i % 2 else "big source", 100 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 50) for i in range(20)]
    rows += [(20_000, None, 5), (20_001, "other", 5), (20_002, "small", None)]
    t = [("big_source", 0.5, 2), ("small", 0.4, 3), ("none_such", 0.1, 5)]
    return mixing.Mix(spark.createDataFrame(rows, "id long, source string, tokens long").na.fill(0, ["tokens"]), spark.createDataFrame(t, "source string, target_share double, max_repeats int"))


def test_mixing(mix):
    r = {x.source: x for x in mix.report().collect()}
    total = r["big_source"].tokens + r["small"].tokens
    assert not r["small"].reachable and r["small"].used_tokens == 3 * r["small"].tokens and not r["none_such"].reachable
    want = 0.5 * total / 2
    assert r["big_source"].reachable and want - 107 < r["big_source"].used_tokens <= want
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9


def test_mixing_nested(spark, mix):
    small = {r.id for r in mix.plan().filter("source = 'big_source'").collect()}
    larger = mixing.Mix(mix.rows.select("id", "source", "tokens"), mix.targets, 0.8)
    assert small <= {r.id for r in larger.plan().filter("source = 'big_source'").collect()}
    empty = mixing.Mix(mix.rows.select("id", "source", "tokens").limit(0), mix.targets)
    assert empty.plan().count() == 0 and empty.report().count() == 3


SAMPLES = [
    ("en", "The river song measures the eleven syllables near the village gate."), ("en", "A careful teacher answers the drum of the assembly in the morning."),
    ("de", "Der Erklärer schließt die Grenze der Wörter nach der dritten Pressung."), ("de", "Dieses Lied erwähnt eine ungewöhnliche Endung zum ersten Mal und wird gelobt."),
    ("hi", "पहले हमारा पुराना शिक्षक पंक्ति के अंत में वाक्य के अर्थ को सुधारता है।"), ("hi", "यहाँ गाँव का विद्यार्थी बहुत ध्यान से पुराने पाठ को बाँटता है।"),
]


def test_languages(spark):
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SAMPLES)] + [(90, None, "x"), (91, "en", " ")], "sample_id long, lang string, sample_text string")
    en, de, hi = (SAMPLES[i][1] for i in (0, 2, 4))
    docs = [(1, en + " " + en, "English"), (2, en + "\n" + de, "en"), (3, hi, None), (4, de, "und"), (5, en, "de-AT"), (6, None, "en"), (7, " \n", "en"), (8, "12 34 ¶¶ " * 30, "en"), (9, en * 500, "en"), (10, "Mandala: 1\nRishis: " + "Ab" * 60 + "\nENG: " + en, "EN"), (11, "\n".join([de[:40], "[Verse 1]", "Rishis: " + "x" * 60, en]), "en")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, lang string, main string")
    m = langid.fit(s)
    r = {x.doc_id: x for x in langid.relabel(d, m).collect()}
    assert r[1].wrong is False and r[2].langs == ["de", "en"] and r[2].wrong and r[3].langs == ["hi"] and r[3].wrong and r[4].main == "de" and r[4].wrong and r[5].wrong and r[5].main == "en"
    assert not {6, 7} & set(r) and (r[8].main, r[8].langs, r[8].confidence, r[8].wrong) == (None, [], 0.0, False) and r[9].wrong is False and r[10].wrong is False and 0 < r[1].confidence <= 1
    assert r[11].langs == ["en"]  # tags between segments are no part of a stretch
    assert langid.relabel(d.limit(0), m).count() == 0


def test_languages_of_short_text(spark):
    s = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SAMPLES)], "sample_id long, lang string, sample_text string")
    en, de = "The river song measures the eleven.", "Der Erklärer schließt die Grenze."
    d = spark.createDataFrame([(1, en, "en"), (2, de, "en"), (3, "\n".join([en, de] * 5), "en"), (4, "\n".join([en, de, en, SAMPLES[2][1], en, en[:20], de, en]), None)], "doc_id long, text string, lang string")
    r = {x.doc_id: x for x in langid.relabel(d, langid.fit(s)).collect()}
    assert {k: (x.main, x.langs, x.wrong) for k, x in r.items()} == {1: ("en", [], False), 2: ("de", [], True), 3: ("en", [], False), 4: ("en", ["de"], True)}
    assert all(0 < x.confidence <= 1 for x in r.values())
