"""Words with all their parts, and the wide letter table and verse documents made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chandas.common import shuffle_partitions
from chandas.functions import phonology as P
from chandas.functions import syllables, text

from . import align, frequency


def _letter(value, has_swara, swara_type):
    return text.let(P.features(value), lambda p: F.struct(
        value.alias("value"), has_swara.alias("hasSwara"), swara_type.alias("swaraType"), p["class"].alias("phonemeClass"), p["vowelLength"].alias("vowelLength"), p.alias("phoneme"),
    ))


def _dev(x):
    return _letter(x["value"], x["has_swara"], x["swara_type"])


def _iast(x):
    return _letter(x, F.lit(False), F.lit(None).cast("string"))


def _syllable(s, make, swaras):
    return F.struct(
        F.transform(s["onset"], make).alias("onset"), make(s["nucleus"]).alias("nucleus"), F.transform(s["coda"], make).alias("coda"), s["weight"].alias("weight"), swaras.alias("swaras"),
    )


def nested_words(verses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each Devanagari word: its aligned texts, letters, syllables of both scripts, and syllables side by side."""
    w = align.aligned_words(verses, keys)
    none = F.array().cast("array<string>")
    dev = F.transform(syllables.dev_syllables(F.col("text")), lambda s: _syllable(s, _dev, s["swaras"]))
    iast = F.transform(syllables.iast_syllables(F.col("aligned_iast")), lambda s: _syllable(s, _iast, none))
    parts = F.struct(F.transform(P.dev_letters(F.col("text")), _dev).alias("letters"), dev.alias("dev_syllables"), iast.alias("iast_syllables"))
    # the generator keeps what follows from working the parts out again for each use
    w = w.select("*", F.explode_outer(F.array(parts)).alias("_p")).select(*w.columns, "_p.*")
    n = F.least(F.size("dev_syllables"), F.size("iast_syllables"))
    pair = F.zip_with(F.slice("dev_syllables", 1, n), F.slice("iast_syllables", 1, n), lambda d, i: F.struct(d.alias("dev"), i.alias("iast")))
    return w.withColumn("alignment", pair)


def _flat(s):
    return F.concat(s["onset"], F.array(s["nucleus"]), s["coda"])


def _spelled(letters):
    return F.array_join(F.transform(letters, lambda x: x["value"]), "")


def letter_rows(hymns: DataFrame, verses: DataFrame) -> DataFrame:
    """The wide table: one row for each letter place of each syllable, in the 31 columns of the full export.

    verses: hymn_index, verse_ord, verse_number, meter, dev, iast. A consonant that is onset and nucleus counts twice.
    Missing letters are null. Verses without a hymn row keep null hymn columns. Verses are partitioned by their keys
    before they are taken apart, so that the many rows made of them needn't move to meet their verse again.
    """
    keys = ["hymn_index", "verse_ord"]
    verses = verses.repartition(shuffle_partitions(verses.sparkSession), *keys)
    w = align.aligned_words(verses, keys)
    shown = F.coalesce(F.nullif("aligned_iast", F.lit("")), "iast_word", F.lit(""))
    w = w.withColumns({"word_iast": shown, "iast_syllables": syllables.iast_syllables(F.col("aligned_iast")), "dev_syllables": syllables.dev_syllables(F.col("text"))})
    w = w.select(*keys, "word_ord", "text", "word_iast", "iast_syllables", F.posexplode_outer("dev_syllables").alias("syllable_index", "s")).filter("s is not null")
    w = w.withColumn("t", F.try_element_at("iast_syllables", F.col("syllable_index") + 1)).drop("iast_syllables")
    none = F.array().cast("array<string>")
    w = w.withColumns({"d": _flat(F.col("s")), "i": F.coalesce(_flat(F.col("t")), none)})
    spelled = lambda c: F.coalesce(F.array_join(c, ""), F.lit(""))
    w = w.withColumn("letter_index", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("d"), F.size("i")) - 1)))
    at = lambda c: F.try_element_at(c, F.col("letter_index") + 1)
    # letters are classified one a row, inside code generation
    w = w.withColumns({"x": at("d"), "y": at("i")})
    d, i = F.col("x"), F.col("y")
    rows = w.select(
        *keys, F.col("word_ord").alias("Word_Index"), F.col("text").alias("Word_DEV"), F.col("word_iast").alias("Word_IAST"), F.col("syllable_index").alias("Syllable_Index"),
        F.concat(_spelled("s.onset"), F.col("s.nucleus.value"), _spelled("s.coda")).alias("Syllable_DEV"), spelled("i").alias("Syllable_IAST"),
        _spelled("s.onset").alias("Syllable_Onset"), F.col("s.nucleus.value").alias("Syllable_Nucleus"), _spelled("s.coda").alias("Syllable_Coda"),
        F.col("s.weight").alias("Syllable_Weight"), F.array_join("s.swaras", "|").alias("Syllable_Swaras"), spelled("i").alias("Syllable_IAST_Letters"),
        F.when(d.isNotNull(), F.col("letter_index")).alias("Letter_Index"), d["value"].alias("Letter_Value"), d["has_swara"].alias("Letter_HasSwara"), d["swara_type"].alias("Letter_SwaraType"),
        F.when(d.isNotNull(), P.phoneme_class(d["value"])).alias("Letter_PhonemeClass"), F.when(d.isNotNull(), P.vowel_length(d["value"])).alias("Letter_VowelLength"),
        F.when(i.isNotNull(), F.col("letter_index")).alias("Letter_IAST_Index"), i.alias("Letter_IAST_Value"),
        F.when(i.isNotNull(), P.phoneme_class(i)).alias("Letter_IAST_PhonemeClass"), F.when(i.isNotNull(), P.vowel_length(i)).alias("Letter_IAST_VowelLength"),
    )
    v = verses.select(*keys, F.col("verse_number").alias("Verse"), F.col("meter").alias("Meter"), F.col("dev").alias("Verse_DEV"), F.col("iast").alias("Verse_IAST"))
    bar = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    h = hymns.select("hymn_index", F.col("mandala").alias("Mandala"), F.col("sukta").alias("Sukta"), bar("rishis").alias("Rishis"), bar("devatas").alias("Devatas"), bar("categories").alias("Categories"))
    out = rows.join(v, keys).join(h, "hymn_index", "left")
    front = ["Mandala", "Sukta", "Rishis", "Devatas", "Categories", "Verse", "Meter", "Verse_DEV", "Verse_IAST"]
    return out.select(*keys, *front, *[c for c in rows.columns if c not in keys])


def verse_documents(verses: DataFrame) -> DataFrame:
    """hymn_index, verse_ord, document: each verse as a nested struct in the JSON export's shape. Verses without words or boundaries have empty arrays.

    A verse of some hundred bytes becomes a document of about 100 KB, so verses are spread over all tasks beforehand,
    by the keys that everything is joined on afterwards: the small rows move, the documents don't.
    """
    keys = ["hymn_index", "verse_ord"]
    verses = verses.repartition(shuffle_partitions(verses.sparkSession), *keys)
    w = nested_words(verses, keys)
    word = F.struct(
        "text", F.col("text").alias("underlyingText"), F.coalesce(F.nullif("underlying_dev_text", F.lit("")), "text").alias("underlyingDevText"), F.col("aligned_iast").alias("alignedIAST"),
        F.col("aligned_iast_underlying").alias("alignedIASTUnderlying"), "letters", F.col("dev_syllables").alias("devSyllables"), F.array().cast("array<string>").alias("iastSyllables"), "alignment",
    )
    by_word = w.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_ord", word.alias("w")))), lambda x: x["w"]).alias("devWords"))
    camel = {
        "surface_word_index": "surfaceWordIndex", "left_underlying_word_index": "leftUnderlyingWordIndex", "right_underlying_word_index": "rightUnderlyingWordIndex", "surface_dev": "surfaceDev",
        "surface_iast": "surfaceIAST", "segmented_dev": "segmentedDev", "segmented_iast": "segmentedIAST", "left_underlying_dev": "leftUnderlyingDev", "left_underlying_iast": "leftUnderlyingIAST",
        "right_underlying_dev": "rightUnderlyingDev", "right_underlying_iast": "rightUnderlyingIAST", "category": "category", "subtype": "subtype", "confidence": "confidence", "notes": "notes",
        "normalization_status": "normalizationStatus", "detected": "detected",
    }
    b = align.boundaries(verses, keys).select(*keys, F.struct(*[F.col(k).alias(v) for k, v in camel.items()]).alias("b"))
    by_boundary = b.groupBy(*keys).agg(F.array_sort(F.collect_list("b"), lambda x, y: x["leftUnderlyingWordIndex"] - y["leftUnderlyingWordIndex"]).alias("sandhi"))
    none = F.array().cast("array<string>")
    entry = F.struct("feat_key", "feat_value")
    counted = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("feat_type") == kind, entry))))
    by_count = frequency.analysis_rows(verses, keys).groupBy(*keys).agg(counted("Letter").alias("_letters"), counted("Swara").alias("_swaras"), counted("PhonemeClass").alias("_classes"))
    empty = F.create_map().cast("map<string,bigint>")
    analysis = F.struct(
        F.coalesce("_letters", empty).alias("letterFrequency"), F.coalesce("_swaras", empty).alias("swaraFrequency"), F.coalesce("_classes", empty).alias("phonemeClassFrequency"),
        F.coalesce(syllables.line_weights(text.words(text.line(verses, "dev"))), none).alias("meterPattern"),
    )
    iast_words = F.transform(F.coalesce(text.words(text.line(verses, "iast")), none), lambda w_: F.struct(w_.alias("text"), F.transform(P.iast_units(w_), _iast).alias("letters"), F.transform(syllables.iast_syllables(w_), lambda s: _syllable(s, _iast, F.array().cast("array<string>"))).alias("iastSyllables")))
    v = verses.join(by_count, keys, "left").select(*keys, "verse_number", "meter", "dev", "iast", "eng", analysis.alias("analysis"), iast_words.alias("iastWords"))
    out = v.join(by_word, keys, "left").join(by_boundary, keys, "left")
    filled = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    doc = F.struct(F.col("verse_number").alias("verseNumber"), "meter", "dev", "iast", "eng", filled("devWords"), "iastWords", filled("sandhi"), "analysis")
    return out.select(*keys, doc.alias("document"))
