"""Counts of letters, accents and sound classes, n-grams, and words by class.

Input of all: a frame of verses with key columns, and `dev` (or arrays made from it). Null and blank lines count
nothing. Letters are exploded once; classes are looked up after counting, on the few distinct letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chandas.functions import phonology as P
from chandas.functions import text

#: Not counted as letters (a single bar of the other kind is).
UNCOUNTED = ("|", "॥")


def unit_counts(verses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit (a letter with its accent marks), n: the one exploded pass that all frequencies come from."""
    units = F.flatten(F.transform(text.words(text.line(verses, "dev")), P.marked_units))
    # outer: an inner explode would first work the array out once more to drop empty ones
    return verses.select(*keys, F.explode_outer(units).alias("unit")).filter("unit is not null").groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("n"))


def letter_frequency(units: DataFrame, keys: list[str]) -> DataFrame:
    by = units.withColumn("letter", F.substring("unit", 1, 1)).filter(~F.col("letter").isin(*UNCOUNTED))
    return by.groupBy(*keys, "letter").agg(F.sum("n").alias("n"))


def swara_frequency(units: DataFrame, keys: list[str]) -> DataFrame:
    """Letters without a mark count as udatta."""
    return units.withColumn("swara", P.swara_of_unit(F.col("unit"))).groupBy(*keys, "swara").agg(F.sum("n").alias("n"))


def phoneme_class_frequency(units: DataFrame, keys: list[str]) -> DataFrame:
    """Other is left out."""
    by = units.withColumn("phoneme_class", P.phoneme_class(F.substring("unit", 1, 1))).filter("phoneme_class <> 'Other'")
    return by.groupBy(*keys, "phoneme_class").agg(F.sum("n").alias("n"))


def analysis_rows(verses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feat_type, feat_key, feat_value: the three frequencies as one table. One shuffle of partial counts."""
    units = unit_counts(verses, keys)
    kinds = F.array(
        F.struct(F.lit("Letter").alias("feat_type"), F.when(~F.substring("unit", 1, 1).isin(*UNCOUNTED), F.substring("unit", 1, 1)).alias("feat_key")),
        F.struct(F.lit("Swara").alias("feat_type"), P.swara_of_unit(F.col("unit")).alias("feat_key")),
        F.struct(F.lit("PhonemeClass").alias("feat_type"), F.nullif(P.phoneme_class(F.substring("unit", 1, 1)), F.lit("Other")).alias("feat_key")),
    )
    rows = units.select(*keys, "n", F.inline(kinds)).filter("feat_key is not null")
    return rows.groupBy(*keys, "feat_type", "feat_key").agg(F.sum("n").alias("feat_value"))


def line_values(dev: Column) -> Column:
    """All letters of a line in order, without accents."""
    return F.flatten(F.transform(text.words(dev), P.dev_values))


def ngram_frequency(verses: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Letter n-grams of each verse, across word boundaries."""
    grams = text.ngrams(line_values(F.col(text.line(verses, "dev"))), n)
    return verses.select(*keys, F.explode_outer(grams).alias("ngram")).filter("ngram is not null").groupBy(*keys, "ngram").agg(F.count(F.lit(1)).alias("n"))


def class_sequence(verses: DataFrame, keys: list[str]) -> DataFrame:
    """Consonant class symbols of each verse, in order."""
    return verses.select(*keys, F.array_join(P.class_symbols(line_values(F.col(text.line(verses, "dev")))), "").alias("sequence"))


def words_with_class(verses: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Words with at least one letter of a class, in order; class None stands for vowels and others."""
    wanted = ["Vowel", "Other"] if cls == "None" else [cls]
    w = verses.select(*keys, F.posexplode(text.words(text.line(verses, "dev"))).alias("word_ord", "word"))
    return w.filter(F.exists(P.dev_values(F.col("word")), lambda x: P.phoneme_class(x).isin(*wanted)))
