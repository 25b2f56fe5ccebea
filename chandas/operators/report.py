"""The detail report of loaded verses as frames: lines, words, letters, syllables, and syllables side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chandas.functions import meter, syllables, text
from chandas.functions import phonology as P

from . import align


def verse_lines(verses: DataFrame) -> DataFrame:
    """hymn_index, verse_ord, verse_number, pada_counts, meter, dev_syllables, iast_syllables. verses: these keys, dev, iast."""
    total = lambda line, n: F.coalesce(F.aggregate(text.words(line), F.lit(0), lambda a, w: a + n(w)), F.lit(0)).cast("long")
    v = verses.select(
        "hymn_index", "verse_ord", "verse_number", meter.pada_counts(F.col("dev"), F.col("iast"), F.col(text.line(verses, "iast"))).alias("_c"),
        total(text.line(verses, "dev"), syllables.dev_count).alias("dev_syllables"), total(text.line(verses, "iast"), syllables.iast_count).alias("iast_syllables"),
    )
    return v.select("hymn_index", "verse_ord", "verse_number", meter.format_counts(F.col("_c")).alias("pada_counts"), meter.detect(F.col("_c")).alias("meter"), "dev_syllables", "iast_syllables")


def word_letters(verses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_ord, letter_ord, value, has_swara, swara_type, phoneme_class, vowel_length: each letter of each Devanagari word."""
    w = verses.select(*keys, F.posexplode(text.words(text.line(verses, "dev"))).alias("word_ord", "word"))
    x = w.select(*keys, "word_ord", F.posexplode_outer(P.dev_letters(F.col("word"))).alias("letter_ord", "x")).filter("x is not null").select(*keys, "word_ord", "letter_ord", "x.*")
    return x.withColumns({"phoneme_class": P.phoneme_class(F.col("value")), "vowel_length": P.vowel_length(F.col("value"))})


def _spelled(s):
    """A Devanagari syllable's letters; a nucleus that is the onset's last consonant is written once."""
    onset, nucleus = F.array_join(F.transform(s["onset"], lambda x: x["value"]), ""), s["nucleus"]["value"]
    coda = F.array_join(F.transform(s["coda"], lambda x: x["value"]), "")
    return F.concat(onset, F.when(F.substring(onset, -1, 1) == nucleus, "").otherwise(nucleus), coda)


def syllable_pairs(verses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_ord, syllable_ord, dev, iast: the syllables of each word and of its aligned Roman words at the same place."""
    w = align.aligned_words(verses, keys)
    pair = F.arrays_zip(syllables.dev_syllables(F.col("text")).alias("d"), syllables.iast_syllables(F.col("aligned_iast")).alias("i"))
    p = w.select(*keys, "word_ord", F.posexplode_outer(pair).alias("syllable_ord", "p")).filter("p.d is not null and p.i is not null")
    iast = F.concat(F.array_join("p.i.onset", ""), F.col("p.i.nucleus"), F.array_join("p.i.coda", ""))
    return p.select(*keys, "word_ord", "syllable_ord", _spelled(F.col("p.d")).alias("dev"), iast.alias("iast"))
