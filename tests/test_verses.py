"""Sample verses against expected spans, meters, syllables and scores."""

import pytest
from pyspark.sql import functions as F

from chandas.functions import meter, phonology, syllables, text, translit
from chandas.operators import align, frequency, similarity

from .fixtures import SPANS, VERSES


@pytest.fixture(scope="module")
def verses(spark):
    return spark.createDataFrame(VERSES, "hymn string, verse int, dev string, iast string")


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_spans_and_categories(verses):
    got = {}
    for r in align.boundaries(verses, ["hymn", "verse"]).orderBy("hymn", "verse", "left_underlying_word_index").collect():
        got.setdefault((r.hymn, r.verse, r.surface_word_index), []).append((r.left_underlying_word_index, r.right_underlying_word_index, r.category))
    want = {(h, v, w): (a, z, c) for h, v, _, w, a, z, c in SPANS}
    assert set(got) == set(want)
    for k, (a, z, cats) in want.items():
        assert [c for _, _, c in got[k]] == cats
        assert got[k][0][0] == a and got[k][-1][1] == z - 1


def test_meters(verses):
    rows = verses.select("hymn", "verse", meter.detect(meter.pada_counts(F.col("dev"), F.col("iast"))).alias("m")).collect()
    got = {(r.hymn, r.verse): r.m for r in rows}
    for h, v, m, *_ in SPANS:
        assert got[h, v] == m, (h, v)


def test_golden_boundary(verses):
    r = align.boundaries(verses.filter("hymn = 'Hymn 1.1' and verse = 1"), ["verse"]).first()
    assert (r.surface_dev, r.surface_iast, r.segmented_dev) == ("अग्निमीळे", "agnimīḻe", "अग्निम ईḻे")


def test_syllables(spark, verses):
    words = verses.filter("hymn = 'Hymn 1.1' and verse = 1").select(F.posexplode(text.words("dev")).alias("i", "w"))
    assert [r.n for r in words.select("i", syllables.dev_count("w").alias("n")).orderBy("i").collect()] == [1, 1, 2, 1, 2, 1, 3]
    s = one(spark, syllables.dev_syllables, "अग्नि")
    assert len(s) == 1 and s[0].nucleus.value == "अ" and [x.value for x in s[0].coda] == ["ग", "न"] and s[0].weight == "light" and not s[0].onset
    s = one(spark, syllables.iast_syllables, "agniṃt")
    assert [(x.onset, x.nucleus, x.coda, x.weight) for x in s] == [([], "a", [], "light"), (["g", "n"], "i", ["ṃ", "t"], "heavy")]
    assert one(spark, syllables.dev_count, "") == 0


def test_units(spark):
    assert one(spark, text.split_iast, "agnaiāu") == ["a", "g", "n", "ai", "ā", "u"]
    assert one(spark, translit.to_dev, "agnim") == "अग्निम"
    assert one(spark, translit.to_dev, "īḻe") == "ईḻे"
    assert one(spark, text.split_code_points, "") == []
    assert one(spark, lambda c: phonology.phoneme_class(c), "ङ") == "Nasal"
    assert one(spark, lambda c: phonology.phoneme_class(c), "A") == "Other"
    assert one(spark, lambda c: phonology.vowel_length(c), "ai") == "Diphthong"
    assert one(spark, lambda c: phonology.phoneme_base(c), "ळ") == "ळ"


def test_ngrams(spark):
    arr = lambda n: one(spark, lambda c: text.ngrams(c, n), ["a", "b", "c"], "array<string>")
    assert arr(2) == ["ab", "bc"] and arr(0) == [""] * 4 and arr(4) == [] and arr(-1) == []


def test_scores(verses):
    v = verses.filter("hymn = 'Hymn 10.125' and verse < 4").withColumn("ord", F.col("verse"))
    units = frequency.unit_counts(v, ["hymn", "ord"])
    f = frequency.phoneme_class_frequency(units, ["hymn", "ord"]).select("hymn", "ord", F.lit("phoneme").alias("kind"), F.col("phoneme_class").alias("key"), F.col("n").alias("value"))
    f = f.unionByName(frequency.swara_frequency(units, ["hymn", "ord"]).select("hymn", "ord", F.lit("swara").alias("kind"), F.col("swara").alias("key"), F.col("n").alias("value")))
    w = v.select("hymn", "ord", F.posexplode(syllables.line_weights(text.words("dev"))).alias("i", "w"))
    f = f.unionByName(w.select("hymn", "ord", F.lit("meter").alias("kind"), F.concat_ws(":", F.col("i") + 1, "w").alias("key"), F.lit(1).cast("long").alias("value")))
    p = similarity.pairs(similarity.profile(f, ["hymn", "ord"]), ["hymn"], "ord", ["phoneme", "swara", "meter"])
    got = {(r.ord_a, r.ord_b): r for r in p.collect()}
    assert len(got) == 3
    r = got[1, 2]
    assert [round(r[f"phoneme_{n}"], 6) for n in similarity.SCORES] == [1163.0, 37.907783, 32.802439, 0.935288, 0.950089]
    assert [round(r[f"swara_{n}"], 6) for n in similarity.SCORES] == [8544.0, 96.0, 89.0, 1.0, 0.684028]
    assert [round(r[f"meter_{n}"], 6) for n in similarity.SCORES] == [13.0, 4.123106, 4.690416, 0.672214, 0.757576]
    assert [round(got[1, 3][f"meter_{n}"], 6) for n in similarity.SCORES] == [15.0, 4.123106, 4.242641, 0.857493, 0.898148]
