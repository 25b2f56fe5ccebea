"""Alignment of Devanagari words with runs of Roman words, and the boundaries inside such runs.

Both word lists of a verse are in one row; the run of each Devanagari word follows from where the one before it ended,
so a fold over the words carries that position. All counts it needs are prefix sums made beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chandas.functions import syllables, text, translit

# Boundary classes with subtype, confidence and notes.
CATEGORIES = {
    "visarga": ("visarga sandhi", "external visarga", "high", "Left underlying form ends in visarga before the next segment."),
    "savarna": ("vowel sandhi", "savarna dirgha", "high", "Adjacent vowels are homorganic and may contract to a long vowel."),
    "glide": ("semivowel sandhi", "external glide formation", "medium", "A final high vowel before another vowel may surface as y, v, r, or l."),
    "vowels": ("vowel sandhi", "heterogeneous vowel contact", "medium", "Adjacent vowels across the boundary suggest vowel sandhi."),
    "consonants": ("consonant sandhi", "external consonant contact", "medium", "Both sides of the boundary are consonantal."),
    "other": ("sandhi candidate", "boundary assimilation", "medium", "Surface token aligns with multiple underlying words."),
}
VOWELS = "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split()
SHIFTING = "i ī u ū ṛ ṝ ḷ".split()
FAMILIES = ["a ā", "i ī", "u ū", "ṛ ṝ", "ḷ"]


def with_spans(verses: DataFrame) -> DataFrame:
    """Adds dev_words, iast_words, iast_dev (each Roman word in Devanagari) and spans(dev_ord, start, len).

    verses: dev, iast and any other columns. A null line has no words. Devanagari words after the last Roman word get
    no span; Roman words after the last Devanagari word are in none.
    """
    none = F.array().cast("array<string>")
    v = verses.withColumns({"dev_words": F.coalesce(text.words(text.line(verses, "dev")), none), "iast_words": F.coalesce(text.words(text.line(verses, "iast")), none)})
    v = v.withColumns({
        "iast_dev": F.transform("iast_words", translit.to_dev),
        "_d": F.transform("dev_words", lambda w: F.struct(syllables.dev_count(w).alias("n"), text.normal_surface(w).alias("s"))),
        # a word's syllables, less one where its first vowel fuses with the final a of the word before
        "_n": F.transform("iast_words", syllables.iast_count),
        "_f": F.transform("iast_words", lambda w, i: F.when((i > 0) & w.rlike("^[iu]") & F.try_element_at("iast_words", i).endswith("a"), 1).otherwise(0)),
    })
    zero = F.array(F.lit(0))
    sums = F.aggregate(
        F.zip_with("_n", "_f", lambda n, f: n - f), zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    v = v.withColumns({"_p": sums, "_t": F.transform("iast_dev", text.normal_surface)})
    fold = """
    aggregate(
      sequence(0, size(dev_words) - 1),
      named_struct('s', 0, 'spans', cast(array() as array<struct<dev_ord: int, start: int, len: int>>)),
      (st, i) -> if(st.s >= size(iast_words), st,
        transform(array(
          if(_d[i].s <> '' AND _d[i].s = _t[st.s], 1,
            least(size(iast_words) - st.s,
              greatest(1, size(iast_words) - st.s - (size(dev_words) - i - 1),
                coalesce(try_element_at(filter(sequence(1, size(iast_words) - st.s), l -> _p[st.s + l] - _p[st.s] + _f[st.s] >= _d[i].n), 1), size(iast_words) - st.s))))
        ), l -> named_struct('s', st.s + l, 'spans', concat(st.spans, array(named_struct('dev_ord', i, 'start', st.s, 'len', l)))))[0]),
      st -> st.spans)
    """
    empty = F.expr("cast(array() as array<struct<dev_ord: int, start: int, len: int>>)")
    spans = F.when((F.size("dev_words") > 0) & (F.size("iast_words") > 0), F.expr(fold)).otherwise(empty)
    return v.withColumn("spans", spans).drop("_d", "_n", "_f", "_p", "_t")


def aligned_words(verses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each Devanagari word: keys, word_ord, text, aligned_iast, aligned_iast_underlying, underlying_dev_text, iast_word (at the same place)."""
    v = with_spans(verses)
    part = lambda src, sep: F.array_join(F.slice(src, F.col("span.start") + 1, F.col("span.len")), sep)
    w = v.select(*keys, "iast_words", "iast_dev", "spans", F.posexplode("dev_words").alias("word_ord", "text"))
    w = w.withColumn("span", F.try_element_at("spans", F.col("word_ord") + 1))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return w.select(
        *keys, "word_ord", "text", blank(part("iast_words", "")).alias("aligned_iast"), blank(part("iast_words", " ")).alias("aligned_iast_underlying"),
        F.coalesce(part("iast_dev", " "), F.lit("")).alias("underlying_dev_text"), F.try_element_at("iast_words", F.col("word_ord") + 1).alias("iast_word"),
    )


def classify(left, right):
    """Struct of category, subtype, confidence, notes for a left and right word."""
    return text.let(F.struct(translit.last_unit(left).alias("a"), translit.first_unit(right).alias("b")), lambda u: _classes(u["a"], u["b"]))


def _classes(a, b):
    vowel = lambda u: u.isin(*VOWELS)
    same = F.lit(False)
    for f in FAMILIES:
        same = same | (a.isin(*f.split()) & b.isin(*f.split()))
    row = lambda k: F.struct(*[F.lit(x).alias(n) for x, n in zip(CATEGORIES[k], ("category", "subtype", "confidence", "notes"))])
    return (
        F.when(a == "ḥ", row("visarga")).when(vowel(a) & vowel(b) & same, row("savarna")).when(vowel(a) & vowel(b) & a.isin(*SHIFTING), row("glide"))
        .when(vowel(a) & vowel(b), row("vowels")).when((a != "") & (b != "") & ~vowel(a) & ~vowel(b), row("consonants")).otherwise(row("other"))
    )


def boundaries(verses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each boundary inside a run of two or more Roman words, in the export's columns."""
    v = with_spans(verses).select(*keys, "dev_words", "iast_words", "iast_dev", F.explode_outer("spans").alias("span")).filter("span.len > 1")
    v = v.withColumn("left_index", F.explode(F.sequence(F.col("span.start"), F.col("span.start") + F.col("span.len") - 2)))
    at = lambda src, i: F.try_element_at(src, i + 1)
    part = lambda src, sep: F.array_join(F.slice(src, F.col("span.start") + 1, F.col("span.len")), sep)
    left, right = F.col("left_index"), F.col("left_index") + 1
    v = v.withColumns({"_l": at("iast_words", left), "_r": at("iast_words", right)})
    # the generator keeps the class from being worked out once for each of its columns
    v = v.select("*", F.explode_outer(F.array(classify(F.col("_l"), F.col("_r")))).alias("_c"))
    return v.select(
        *keys, F.col("span.dev_ord").alias("surface_word_index"), at("dev_words", F.col("span.dev_ord")).alias("surface_dev"), part("iast_words", "").alias("surface_iast"),
        part("iast_dev", " ").alias("segmented_dev"), part("iast_words", " ").alias("segmented_iast"),
        left.alias("left_underlying_word_index"), at("iast_dev", left).alias("left_underlying_dev"), F.col("_l").alias("left_underlying_iast"),
        right.alias("right_underlying_word_index"), at("iast_dev", right).alias("right_underlying_dev"), F.col("_r").alias("right_underlying_iast"),
        "_c.category", "_c.subtype", "_c.confidence", F.lit("generated").alias("normalization_status"), F.lit(True).alias("detected"), "_c.notes",
    )
