"""Registered searches over words and their aligned Roman words, against brute force on a few verses."""

import re

import pytest

from chandas.operators import search
from chandas.plans import reference

# dev, iast, and each Devanagari word's Roman words spelled in Devanagari by hand
ROWS = [
    ("क स्म ख", "smara ka kha", ["स्मर", "क", "ख"]), ("पथ", "pra tha", ["प्र थ"]), ("गच्छति", "gacchanti", ["गच्छन्ति"]),
    ("अस्थ यत", "astha stana", ["अस्थ", "स्तन"]), ("प्रजा सन्ति", "gaja gata", ["गज", "गत"]), ("वन", None, [None]),
]
TESTS = {
    "search_words_containing": lambda w: "स्म" in w, "search_words_prefix": lambda w: w.startswith("प्र"), "search_words_suffix": lambda w: w.endswith("न्ति"),
    "search_words_regex": lambda w: bool(re.search("स्[तथ]", w)), "search_words_regex_bytes": lambda w: bool(re.search("स्त.*न".encode(), w.encode())),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("search")
    rows = [(i, 1, i, i, dev, iast, None, None, None, "2024-01-01") for i, (dev, iast, _) in enumerate(ROWS)]
    kinds = "verse_id long, hymn_index int, verse_ord int, verse_number int, dev string, iast string, eng string, meter string, pada_counts array<int>, loaded_at string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{at}/verses.parquet")
    hymns = "hymn_index int, source_path string, export_base string, mandala int, sukta int, rishis array<string>, devatas array<string>, categories array<string>, loaded_at string"
    spark.createDataFrame([(1, "a.txt", "a", 1, 1, None, None, None, "2024-01-01")], hymns).write.parquet(f"{at}/hymns.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(TESTS))
def test_full_searches_equal_brute_force(spark, folder, name):
    test, want, by_text = TESTS[name], set(), set()
    for i, (dev, _, spelled) in enumerate(ROWS):
        for n, (word, other) in enumerate(zip(dev.split(), spelled)):
            by_text |= {(i, n)} if test(word) else set()
            want |= {(i, n)} if test(word) or (other and test(other)) else set()
    assert by_text < want
    assert sorted((r.verse_ord, r.word_ord) for r in reference.QUERIES[name](spark, folder).collect()) == sorted(want)


def test_fields_and_bad_patterns(spark, folder):
    r = {x.verse_ord: x for x in reference.QUERIES["search_words_prefix"](spark, folder).collect()}
    assert (r[1].export_base, r[1].dev_word, r[1].iast_word, r[1].verse_dev, r[1].verse_iast, r[1].detail) == ("a", "प्र थ", "pra", "पथ", "pra tha", "matched prefix")
    assert reference.QUERIES["search_bad_regex"](spark, folder).count() == 0
    v, p = reference.verses(spark, folder), search.parse
    assert search.bad_pattern(v, p("find vowel span patterns (a")) == search.BAD_PATTERN and search.bad_pattern(v, p("find vowel span patterns (a)")) is None
    assert search.bad_pattern(v, p("find words containing (a")) is None
    assert search.describe(p("find words ending with -ti")) == 'word ends with "ti"' and search.describe(p("find consonant clusters of length >= 3")) == "consonant cluster length >= 3"
