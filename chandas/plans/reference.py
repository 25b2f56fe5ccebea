"""Queries for the verse operators over the test tables, and SQL that computes the same on another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.common import latest, table
from chandas.functions import meter, syllables, text, translit
from chandas.functions import phonology as P
from chandas.operators import align, compare, frequency, nesting, report, search, similarity
from chandas.sources import sinks, tagged

from . import fold_sql

COLUMNS = ["hymn_index", "verse_ord", "verse_number", "dev", "iast", "eng"]
KEYS = ["hymn_index", "verse_ord", "verse_number"]

# The current row of each verse, and its words, in SQL.
V = """v AS (SELECT * FROM verses WHERE verse_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_WORDS = r"list_filter(list_transform(regexp_split_to_array({c}, '[ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '[।॥|]+$', '')), lambda w: w <> '')"
_BARE = "regexp_replace({c}, '[॒̱॑̍]', '', 'g')"
DEV_WORDS, IAST_WORDS = _WORDS.format(c="dev"), _WORDS.format(c="iast")
L = f"{V}, w AS (SELECT hymn_index, verse_ord, verse_number, iast, unnest({DEV_WORDS}) AS word FROM v), l AS (SELECT hymn_index, verse_ord, verse_number, unnest(string_split({_BARE.format(c='word')}, '')) AS letter FROM w)"
CLASSES = "classes AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in P.CLASS_OF.items()) + ") t(letter, class))"
SWARA = "CASE WHEN right(unit, 1) IN ('॑', '̍') THEN 'svarita' WHEN right(unit, 1) IN ('॒', '̱') THEN 'anudatta' ELSE 'udatta' END"
UNITS = f"{V}, w AS (SELECT hymn_index, verse_ord, verse_number, unnest({DEV_WORDS}) AS word FROM v), u AS (SELECT hymn_index, verse_ord, verse_number, unnest(regexp_extract_all(word, '[^॒̱॑̍][॒̱॑̍]*')) AS unit FROM w)"


def verses(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "verses").filter("verse_id is not null"), ["verse_id"], ["loaded_at"], [*COLUMNS, "meter", "pada_counts"])


def hymns(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["source_path", "export_base", "mandala", "sukta", "rishis", "devatas", "categories"]
    return latest(table(spark, sf, "hymns").filter("hymn_index is not null"), ["hymn_index"], ["loaded_at"], cols)


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# frequencies -----------------------------------------------------------------------------------------------------------
@query(f"WITH {L} SELECT hymn_index, letter, count(*) AS n FROM l WHERE letter NOT IN ('|', '॥') GROUP BY 1, 2")
def letter_frequency(spark, sf):
    return frequency.letter_frequency(frequency.unit_counts(verses(spark, sf), ["hymn_index"]), ["hymn_index"])


@query(f"WITH {L} SELECT hymn_index, verse_ord, letter, count(*) AS n FROM l WHERE letter NOT IN ('|', '॥') GROUP BY 1, 2, 3")
def verse_letter_frequency(spark, sf):
    k = ["hymn_index", "verse_ord"]
    return frequency.letter_frequency(frequency.unit_counts(verses(spark, sf), k), k)


@query(f"WITH {UNITS} SELECT hymn_index, {SWARA} AS swara, count(*) AS n FROM u GROUP BY 1, 2")
def swara_frequency(spark, sf):
    return frequency.swara_frequency(frequency.unit_counts(verses(spark, sf), ["hymn_index"]), ["hymn_index"])


@query(f"WITH {UNITS} SELECT hymn_index, verse_ord, {SWARA} AS swara, count(*) AS n FROM u GROUP BY 1, 2, 3")
def verse_swara_frequency(spark, sf):
    k = ["hymn_index", "verse_ord"]
    return frequency.swara_frequency(frequency.unit_counts(verses(spark, sf), k), k)


@query(f"WITH {L}, {CLASSES} SELECT hymn_index, class AS phoneme_class, count(*) AS n FROM l JOIN classes USING (letter) GROUP BY 1, 2")
def phoneme_class_frequency(spark, sf):
    return frequency.phoneme_class_frequency(frequency.unit_counts(verses(spark, sf), ["hymn_index"]), ["hymn_index"])


@query(f"WITH {L}, {CLASSES} SELECT hymn_index, verse_ord, class AS phoneme_class, count(*) AS n FROM l JOIN classes USING (letter) GROUP BY 1, 2, 3")
def verse_phoneme_class_frequency(spark, sf):
    k = ["hymn_index", "verse_ord"]
    return frequency.phoneme_class_frequency(frequency.unit_counts(verses(spark, sf), k), k)


@query(
    f"WITH {UNITS}, {CLASSES}, l AS (SELECT hymn_index, unit[1] AS letter, unit FROM u) SELECT hymn_index, 'Letter' AS feat_type, letter AS feat_key, count(*) AS feat_value FROM l WHERE letter NOT IN ('|', '॥') GROUP BY 1, 3 "
    f"UNION ALL SELECT hymn_index, 'Swara', {SWARA}, count(*) FROM l GROUP BY 1, 3 UNION ALL SELECT hymn_index, 'PhonemeClass', class, count(*) FROM l JOIN classes USING (letter) GROUP BY 1, 3"
)
def analysis_export(spark, sf):
    return frequency.analysis_rows(verses(spark, sf), ["hymn_index"])


@query(
    f"WITH {V}, s AS (SELECT hymn_index, array_to_string({DEV_WORDS}, '') AS t FROM v), b AS (SELECT hymn_index, {_BARE.format(c='t')} AS t FROM s), "
    "g AS (SELECT hymn_index, t, unnest(range(1, length(t) - 1)) AS i FROM b) SELECT hymn_index, substring(t, i, 3) AS ngram, count(*) AS n FROM g GROUP BY 1, 2"
)
def ngrams_3(spark, sf):
    return frequency.ngram_frequency(verses(spark, sf), ["hymn_index"], 3)


_SYMBOL = "CASE class " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in P.SYMBOLS.items()) + " ELSE '' END"


@query(
    f"WITH {V}, {CLASSES}, s AS (SELECT hymn_index, verse_ord, string_split({_BARE.format(c=f'array_to_string({DEV_WORDS}, {chr(39)*2})')}, '') AS a FROM v), "
    f"e AS (SELECT hymn_index, verse_ord, unnest(a) AS letter, unnest(range(len(a))) AS i FROM s), c AS (SELECT e.*, coalesce({_SYMBOL}, '') AS s FROM e LEFT JOIN classes USING (letter)), "
    "g AS (SELECT hymn_index, verse_ord, string_agg(s, '' ORDER BY i) AS sequence FROM c GROUP BY 1, 2) SELECT v.hymn_index, v.verse_ord, CASE WHEN dev IS NULL THEN NULL ELSE coalesce(sequence, '') END AS sequence FROM v LEFT JOIN g USING (hymn_index, verse_ord)"
)
def consonant_class_sequence(spark, sf):
    return frequency.class_sequence(verses(spark, sf), ["hymn_index", "verse_ord"])


_INDEXED = f"{V}, a AS (SELECT hymn_index, verse_ord, verse_number, {DEV_WORDS} AS d, {IAST_WORDS} AS i FROM v), w AS (SELECT hymn_index, verse_ord, verse_number, i, unnest(d) AS word, unnest(range(len(d))) AS n FROM a)"


@query(f"WITH {_INDEXED} SELECT hymn_index, verse_ord, n::INT AS word_ord, word FROM w WHERE regexp_matches(word, '[हःhḥ]')")
def words_with_class(spark, sf):
    return frequency.words_with_class(verses(spark, sf), ["hymn_index", "verse_ord"], "Aspirate")


@query(
    f"WITH {V}, w AS (SELECT unnest({IAST_WORDS}) AS word FROM v), u AS (SELECT unnest(regexp_extract_all(word, '(?s)(ai|au|.)')) AS unit FROM w) SELECT unit, count(*) AS n FROM u GROUP BY 1"
)
def iast_unit_frequency(spark, sf):
    v = verses(spark, sf).select(F.explode(F.flatten(F.transform(text.words("iast"), text.split_iast))).alias("unit"))
    return v.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


_DIM = ", ".join(
    f"('{k}', '{'Vowel' if c == 'Vowel' else 'Consonant'}', '{c}', '{'Short' if k in P.SHORT else 'Long' if k in P.LONG else 'Diphthong' if k in P.DIPHTHONG else 'None'}', '{P.BASE_OF[k]}')"
    for k, c in P.CLASS_OF.items()
)


@query(
    f"WITH {L}, d AS (SELECT * FROM (VALUES {_DIM}) t(letter, type, class, length, base)) SELECT DISTINCT letter, coalesce(type, 'Other') AS type, coalesce(class, 'Other') AS class, coalesce(length, 'None') AS length, coalesce(base, letter) AS base FROM l LEFT JOIN d USING (letter)"
)
def phoneme_features(spark, sf):
    x = frequency.unit_counts(verses(spark, sf), ["hymn_index"]).select(F.substring("unit", 1, 1).alias("letter")).distinct()
    c = F.col("letter")
    return x.select("letter", P.phoneme_type(c).alias("type"), P.phoneme_class(c).alias("class"), P.vowel_length(c).alias("length"), P.phoneme_base(c).alias("base"))


# search ----------------------------------------------------------------------------------------------------------------
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Verses with the export name of their hymn; verses without a hymn row keep a null one."""
    return verses(spark, sf).join(hymns(spark, sf).select("hymn_index", "export_base"), "hymn_index", "left")


FOUND = ["hymn_index", "export_base", "verse_ord", "verse_number"]


def _search(name: str, request: str, where: str, detail: str = "", mode: str = "reference") -> None:
    def run(spark, sf):
        return search.search(labelled(spark, sf), search.parse(request), FOUND, mode)

    QUERIES[name] = run
    SQL[name] = fold_sql.search(where, detail)


_search("search_words_containing", "find all occurrences of 'स्म'", "contains(surface, 'स्म') OR contains(text, 'स्म')", "'matched word text'")
_search("search_words_prefix", "find words beginning with प्र", "starts_with(surface, 'प्र') OR starts_with(text, 'प्र')", "'matched prefix'")
_search("search_words_suffix", "find words ending with न्ति", "ends_with(surface, 'न्ति') OR ends_with(text, 'न्ति')", "'matched suffix'")
_search("search_words_regex", "find vowel span patterns स्[तथ]", "regexp_matches(surface, 'स्[तथ]') OR regexp_matches(text, 'स्[तथ]') OR regexp_matches(roman, 'स्[तथ]')", "'matched regex pattern'", "corrected")
_search("search_words_regex_bytes", "find vowel span patterns स्त.*न", "regexp_matches(surface, 'स्त(?s:.)*न') OR regexp_matches(text, 'स्त(?s:.)*न')", "'matched regex pattern'")
_search("search_bad_regex", "find vowel span patterns स्[तथ", "false", "'matched regex pattern'")
_search("search_phoneme_class", "phoneme class Aspirate", "regexp_matches(text, '[हःhḥ]')", "'matched phoneme class'")
_search("search_manner", "manner of articulation nasals", "regexp_matches(text, '[ङञणनमंँṅñṇnmṃṁ]')", "'matched manner of articulation'")
_LONGEST = "list_max(list_transform(regexp_split_to_array(text, 'ai|au|[aāiīuūṛṝḷeo।॥|]'), lambda x: length(x)))"
_search("search_cluster_length", "find consonant clusters of length >= 12", f"{_LONGEST} >= 12", f"'cluster length ' || {_LONGEST}")
_search("search_words_bare_text", "  'गच्छ'  ", "contains(surface, 'गच्छ') OR contains(text, 'गच्छ')", "'matched word text'")
_search("search_words_find_containing", "Find words containing `व्य`", "contains(surface, 'व्य') OR contains(text, 'व्य')", "'matched word text'")
_search("search_roman_words", "find words containing kṣ", "contains(surface, 'kṣ') OR contains(text, 'kṣ') OR contains(lower(roman), 'kṣ')", "'matched word text'", "corrected")


@query(
    f"WITH {V}, h AS (SELECT hymn_index, arg_max(export_base, loaded_at) AS export_base FROM hymns WHERE hymn_index IS NOT NULL GROUP BY 1) SELECT hymn_index, export_base, verse_ord, verse_number, NULL::INT AS word_ord, '' AS dev_word, '' AS iast_word, dev AS verse_dev, iast AS verse_iast, 'matched verse text' AS detail "
    "FROM v LEFT JOIN h USING (hymn_index) WHERE contains(lower(dev), 'river') OR contains(lower(iast), 'river') OR contains(lower(eng), 'river')"
)
def search_verses_containing(spark, sf):
    return search.search(labelled(spark, sf), search.parse("find all verses containing RIVER"), FOUND)


@query(
    f"WITH {_INDEXED}, h AS (SELECT DISTINCT hymn_index FROM hymns WHERE hymn_index IS NOT NULL), m AS (SELECT hymn_index, count(*) AS matches, count(DISTINCT verse_number) AS matched_verses FROM w WHERE regexp_matches(word, '[हःhḥ]') GROUP BY 1), "
    "t AS (SELECT hymn_index, count(*) AS total_verses FROM v GROUP BY 1) SELECT h.hymn_index, coalesce(matches, 0) AS matches, coalesce(matched_verses, 0) AS matched_verses, coalesce(total_verses, 0) AS total_verses, "
    "CASE WHEN coalesce(total_verses, 0) > 0 THEN round(coalesce(matched_verses, 0) / total_verses, 3) ELSE 0.0 END AS coverage FROM h LEFT JOIN m USING (hymn_index) LEFT JOIN t USING (hymn_index)"
)
def query_coverage(spark, sf):
    v = verses(spark, sf)
    return search.coverage(hymns(spark, sf), v, search.search(v, search.parse("phoneme class aspirate"), KEYS))


# prosody ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {V}, w AS (SELECT hymn_index, verse_ord, word FROM v, unnest({IAST_WORDS}) t(word)) SELECT hymn_index, verse_ord, sum(len(regexp_extract_all(word, 'ai|au|[aāiīuūṛṝḷeo]')))::BIGINT AS syllables FROM w GROUP BY 1, 2")
def iast_syllable_count(spark, sf):
    w = verses(spark, sf).select("hymn_index", "verse_ord", F.explode(text.words("iast")).alias("word"))
    return w.groupBy("hymn_index", "verse_ord").agg(F.sum(syllables.iast_count(F.col("word"))).alias("syllables"))


_SEGS = "list_filter(regexp_split_to_array(iast, '[।॥|]'), lambda x: x <> '')"


@query(
    f"WITH {V} SELECT hymn_index, verse_ord, array_to_string(list_transform({_SEGS}, lambda s: coalesce(list_sum(list_transform({_WORDS.format(c='s')}, lambda y: len(regexp_extract_all(y, 'ai|au|[aāiīuūṛṝḷeo]')))), 0)::BIGINT), '-') AS counts FROM v WHERE iast IS NOT NULL"
)
def iast_pada_counts(spark, sf):
    v = verses(spark, sf).filter("iast is not null")
    return v.select("hymn_index", "verse_ord", meter.format_counts(meter.iast_counts(F.col("iast"))).alias("counts"))


@query(fold_sql.METER_OF_COUNTS)
def meter_of_counts(spark, sf):
    v = verses(spark, sf).filter("pada_counts is not null")
    return v.select("hymn_index", "verse_ord", meter.detect(F.col("pada_counts")).alias("meter"))


@query(fold_sql.VERSE_METERS)
def verse_meters(spark, sf):
    """Counts and meters of all verses from their lines, inference included."""
    v = verses(spark, sf).select("hymn_index", "verse_ord", meter.pada_counts(F.col("dev"), F.col("iast")).alias("c"))
    return v.select("hymn_index", "verse_ord", meter.format_counts(F.col("c")).alias("counts"), meter.detect(F.col("c")).alias("meter"))


@query(fold_sql.DEV_SYLLABLE_WEIGHTS)
def dev_syllable_weights(spark, sf):
    return verses(spark, sf).select("hymn_index", "verse_ord", F.array_join(syllables.line_weights(text.words("dev")), " ").alias("weights"))


@query(fold_sql.DEV_SYLLABLES)
def dev_syllables(spark, sf):
    w = verses(spark, sf).select("hymn_index", "verse_ord", F.posexplode(text.words("dev")).alias("word_ord", "word"))
    s = w.select("hymn_index", "verse_ord", "word_ord", F.posexplode_outer(syllables.dev_syllables(F.col("word"))).alias("syllable_ord", "s")).filter("s is not null")
    spell = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), "")
    return s.select("hymn_index", "verse_ord", "word_ord", "syllable_ord", spell("s.onset").alias("onset"), F.col("s.nucleus.value").alias("nucleus"), spell("s.coda").alias("coda"), "s.weight")


@query(fold_sql.IAST_SYLLABLES)
def iast_syllables(spark, sf):
    w = verses(spark, sf).select("hymn_index", "verse_ord", F.posexplode(text.words("iast")).alias("word_ord", "word"))
    s = w.select("hymn_index", "verse_ord", "word_ord", F.posexplode_outer(syllables.iast_syllables(F.col("word"))).alias("syllable_ord", "s")).filter("s is not null")
    return s.select("hymn_index", "verse_ord", "word_ord", "syllable_ord", F.array_join("s.onset", "").alias("onset"), "s.nucleus", F.array_join("s.coda", "").alias("coda"), "s.weight")


@query(fold_sql.STRING_FUNCTIONS)
def string_functions(spark, sf):
    v = verses(spark, sf).filter("eng is not null and dev is not null and iast is not null")
    return v.select(
        "hymn_index", "verse_ord", text.trim_ascii(F.col("eng")).alias("trimmed"), text.fold_ascii(F.col("eng")).alias("folded"), text.normal_surface(F.col("dev")).alias("surface"),
        text.clean_word(F.col("iast")).alias("cleaned"), F.size(text.words("iast")).alias("words"),
    )


@query(fold_sql.LETTER_PARTS)
def letter_parts(spark, sf):
    """The part in a syllable of each letter that occurs."""
    v = verses(spark, sf)
    dev = v.select(F.lit("dev").alias("script"), F.explode(F.flatten(F.transform(text.words("dev"), P.dev_values))).alias("letter"))
    iast = v.select(F.lit("iast").alias("script"), F.explode(F.flatten(F.transform(text.words("iast"), P.iast_units))).alias("letter"))
    x = dev.unionByName(iast).distinct()
    return x.select("script", "letter", F.when(F.col("script") == "dev", syllables.dev_part(F.col("letter"))).otherwise(syllables.iast_part(F.col("letter"))).alias("part"))


@query(fold_sql.WORD_LETTERS)
def word_letters(spark, sf):
    return report.word_letters(verses(spark, sf), ["hymn_index", "verse_ord"])


@query(fold_sql.IAST_LETTERS)
def iast_letters(spark, sf):
    w = verses(spark, sf).select("hymn_index", "verse_ord", F.posexplode(text.words("iast")).alias("word_ord", "word"))
    x = w.select("hymn_index", "verse_ord", "word_ord", F.posexplode_outer(P.iast_units(F.col("word"))).alias("letter_ord", "value")).filter("value is not null")
    return x.withColumns({"phoneme_class": P.phoneme_class(F.col("value")), "vowel_length": P.vowel_length(F.col("value"))})


@query(fold_sql.VERSE_REPORT)
def verse_report(spark, sf):
    """The detail report's lines of verses: pada counts, meter and syllables of both scripts."""
    return report.verse_lines(verses(spark, sf).drop("meter"))


@query(fold_sql.SYLLABLE_PAIRS)
def syllable_pairs(spark, sf):
    """The detail report's syllables of both scripts side by side."""
    return report.syllable_pairs(verses(spark, sf), ["hymn_index", "verse_ord"])


# alignment and boundaries ----------------------------------------------------------------------------------------------
@query(fold_sql.TRANSLITERATE)
def transliterate(spark, sf):
    w = verses(spark, sf).select(F.explode(text.words("iast")).alias("word")).distinct()
    return w.select("word", translit.to_dev(F.col("word")).alias("dev"))


@query(fold_sql.ALIGN_SPANS)
def align_spans(spark, sf):
    return align.aligned_words(verses(spark, sf), ["hymn_index", "verse_ord"])


@query(fold_sql.SANDHI_BOUNDARIES)
def sandhi_boundaries(spark, sf):
    return align.boundaries(verses(spark, sf), ["hymn_index", "verse_ord"])


@query(fold_sql.BOUNDARY_CLASS)
def boundary_class(spark, sf):
    """Classes of the given boundaries from their two words."""
    s = table(spark, sf, "sandhi").filter("boundary_id is not null and left_underlying_iast is not null and right_underlying_iast is not null")
    return s.select("boundary_id", align.classify(F.col("left_underlying_iast"), F.col("right_underlying_iast"))["subtype"].alias("subtype")).distinct()


# similarity ------------------------------------------------------------------------------------------------------------
def _scores(kind: str, n: str) -> str:
    conf = f"CASE WHEN {n}active > 0 AND {n}ta <> 0 AND {n}tb <> 0 THEN ({n}shared / {n}active + least({n}ta, {n}tb) / greatest({n}ta, {n}tb) + least(1.0, {n}active / 8.0)) / 3 ELSE 0.0 END"
    return f"round({n}dot, 6) AS {kind}_dot_product, round(CASE WHEN {n}qa = 0 OR {n}qb = 0 THEN 0.0 ELSE {n}dot / (sqrt({n}qa) * sqrt({n}qb)) END, 6) AS {kind}_cosine_similarity, round({conf}, 6) AS {kind}_confidence"


def _pair_sql(base: str, group: str, kind: str, features: str) -> str:
    """Scores of pairs a < b within a group, from (group, o, key, value) features."""
    return (
        f"WITH {base}, f AS ({features}), t AS (SELECT g, o, sum(value)::DOUBLE AS t, sum(value * value)::DOUBLE AS q, count(*) AS s FROM f GROUP BY 1, 2), o AS ({group}), "
        "d AS (SELECT a.g, a.o AS a, b.o AS b, sum(a.value * b.value)::DOUBLE AS dot, count(*) AS shared FROM f a JOIN f b ON a.g = b.g AND a.key = b.key AND a.o < b.o GROUP BY 1, 2, 3), "
        "p AS (SELECT x.g, x.o AS oa, y.o AS ob, coalesce(dot, 0.0) AS dot, coalesce(shared, 0) AS shared, coalesce(ta.t, 0.0) AS ta, coalesce(tb.t, 0.0) AS tb, coalesce(ta.q, 0.0) AS qa, coalesce(tb.q, 0.0) AS qb, "
        "coalesce(ta.s, 0) + coalesce(tb.s, 0) - coalesce(shared, 0) AS active FROM o x JOIN o y ON x.g = y.g AND x.o < y.o LEFT JOIN t ta ON ta.g = x.g AND ta.o = x.o LEFT JOIN t tb ON tb.g = y.g AND tb.o = y.o "
        f"LEFT JOIN d ON d.g = x.g AND d.a = x.o AND d.b = y.o) SELECT g AS hymn_index, oa AS verse_ord_a, ob AS verse_ord_b, {_scores(kind, '')} FROM p"
    )


def _rounded(df, kind):
    k = [f"{kind}_{s}" for s in ("dot_product", "cosine_similarity", "confidence")]
    return df.select("hymn_index", "verse_ord_a", "verse_ord_b", *[F.round(c, 6).alias(c) for c in k])


_OWNERS = "SELECT hymn_index AS g, verse_ord AS o FROM v"


@query(_pair_sql(f"{L}, {CLASSES}", _OWNERS, "phoneme", "SELECT hymn_index AS g, verse_ord AS o, class AS key, count(*) AS value FROM l JOIN classes USING (letter) GROUP BY 1, 2, 3"))
def verse_similarity_phoneme(spark, sf):
    return _rounded(compare.verse_pairs(verses(spark, sf), ["phoneme", "swara"]), "phoneme")


@query(_pair_sql(UNITS, _OWNERS, "swara", f"SELECT hymn_index AS g, verse_ord AS o, {SWARA} AS key, count(*) AS value FROM u GROUP BY 1, 2, 3"))
def verse_similarity_swara(spark, sf):
    return _rounded(compare.verse_pairs(verses(spark, sf), ["phoneme", "swara"]), "swara")


@query(_pair_sql(
    "c AS (SELECT * FROM verse_analysis WHERE verse_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY exported_at DESC NULLS LAST) = 1), m AS (SELECT hymn_index, verse_id, unnest(meter_pattern) AS w, unnest(range(1, len(meter_pattern) + 1)) AS i FROM c)",
    "SELECT hymn_index AS g, verse_id AS o FROM c", "meter", "SELECT hymn_index AS g, verse_id AS o, i || ':' || w AS key, 1 AS value FROM m",
).replace("verse_ord_", "verse_id_"))
def verse_similarity_meter(spark, sf):
    """From the exported weight patterns."""
    c = latest(table(spark, sf, "verse_analysis").filter("verse_id is not null"), ["verse_id"], ["exported_at"], ["hymn_index", "meter_pattern"])
    f = c.select("hymn_index", "verse_id", F.posexplode("meter_pattern").alias("i", "w"))
    f = f.select("hymn_index", "verse_id", F.lit("meter").alias("kind"), F.concat_ws(":", F.col("i") + 1, "w").alias("key"), F.lit(1).cast("long").alias("value"))
    none = c.select("hymn_index", "verse_id", F.lit("none").alias("kind"), F.lit("").alias("key"), F.lit(1).cast("long").alias("value"))
    p = similarity.pairs(similarity.profile(f.unionByName(none), ["hymn_index", "verse_id"]), ["hymn_index"], "verse_id", ["meter"])
    return p.select("hymn_index", "verse_id_a", "verse_id_b", *[F.round(f"meter_{s}", 6).alias(f"meter_{s}") for s in ("dot_product", "cosine_similarity", "confidence")])


def _scores6(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(f"{k}_{s}", 6).alias(f"{k}_{s}") for k in compare.KINDS for s in similarity.SCORES])


@query(fold_sql.VERSE_SIMILARITY)
def verse_similarity_export(spark, sf):
    return _scores6(compare.verse_pairs(verses(spark, sf)), ["hymn_index", "verse_ord_a", "verse_ord_b", "verse_number_a", "verse_number_b"])


REFERENCES = [(1, 2), (1, 3), (2, 2), (3, 4)]


@query(fold_sql.COMPARE_HYMNS)
def compare_hymns(spark, sf):
    """The hymns that have probes: a selection that grows with the tables (the references are the operator's input)."""
    probes = table(spark, sf, "knn_probes").select(F.floor(F.col("verse_id") / 1000).cast("int").alias("hymn_index")).distinct()
    return compare.compare_hymns(verses(spark, sf).join(probes, "hymn_index", "left_semi"), decimals=6)


@query(fold_sql.compare_verses(REFERENCES))
def compare_verses(spark, sf):
    """Four references as a user would type them."""
    return _scores6(compare.compare_verses(compare.resolve_verses(hymns(spark, sf), verses(spark, sf), REFERENCES)), ["sel_ord_a", "sel_ord_b"])


_D = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(
    f"WITH a AS (SELECT vec_id, {_D} AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS y FROM a JOIN a b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_dot_product(x, y), 6) AS dot_product, round(sqrt(list_dot_product(x, x)), 6) AS magnitude_a, "
    "round(sqrt(list_dot_product(y, y)), 6) AS magnitude_b, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine_similarity FROM p"
)
def embedding_similarity(spark, sf):
    """Each vector with its successor."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return similarity.arrays(p, "x", "y").select("vec_id", *[F.round(c, 6).alias(c) for c in similarity.SCORES[:4]])


# catalog, sources, exports ---------------------------------------------------------------------------------------------
@query(
    f"WITH {V}, h AS (SELECT * FROM hymns WHERE hymn_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hymn_index ORDER BY loaded_at DESC NULLS LAST) = 1), n AS (SELECT hymn_index, count(*) AS verses FROM v GROUP BY 1) "
    "SELECT h.hymn_index, export_base, source_path, coalesce(verses, 0) AS verses FROM h LEFT JOIN n USING (hymn_index)"
)
def catalog_summary(spark, sf):
    n = verses(spark, sf).groupBy("hymn_index").agg(F.count(F.lit(1)).alias("verses"))
    return hymns(spark, sf).select("hymn_index", "export_base", "source_path").join(n, "hymn_index", "left").na.fill(0, ["verses"])


@query(
    r"""SELECT DISTINCT source_path, CASE WHEN s = '' THEN 'Hymn' ELSE s END AS stem FROM (SELECT source_path, translate(regexp_replace(regexp_replace(source_path, '^.*/', ''), '\.[^.]*$', ''), '<>:"/\|?*', '_________') AS s FROM hymns WHERE source_path IS NOT NULL)"""
)
def export_names(spark, sf):
    return table(spark, sf, "hymns").filter("source_path is not null").select("source_path", tagged.export_base(F.col("source_path")).alias("stem")).distinct()


def _files(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id"), "text")


@query(
    r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, nullif(regexp_extract(line, '\[Verse\s*(\d+)\]', 1), '')::INT AS number FROM l) SELECT doc_id, count(*) AS verses, sum(number)::BIGINT AS numbers FROM n WHERE number IS NOT NULL AND number <> 0 GROUP BY 1"
)
def parsed_verse_counts(spark, sf):
    """Tagged hymn files inside the documents, cut into verses."""
    v = tagged.verses(tagged.lines(_files(spark, sf), "doc_id"), "doc_id")
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("verses"), F.sum("verse_number").alias("numbers"))


@query(fold_sql.PARSED_VERSES)
def parsed_verses(spark, sf):
    return tagged.verses(tagged.lines(_files(spark, sf), "doc_id"), "doc_id")


@query(fold_sql.PARSED_HYMNS)
def parsed_hymns(spark, sf):
    h = tagged.hymns(tagged.lines(_files(spark, sf), "doc_id"), "doc_id")
    return h.select("doc_id", "mandala", "sukta", *[F.array_join(c, "|").alias(c) for c in ("rishis", "devatas", "categories")])


@query(fold_sql.PARSED_METERS)
def parsed_meters(spark, sf):
    """Meters assigned to the verses of tagged files."""
    v = tagged.with_meters(tagged.verses(tagged.lines(_files(spark, sf), "doc_id"), "doc_id"))
    return v.select("doc_id", "verse_ord", "verse_number", "counts", "meter")


@query(fold_sql.LETTER_TABLE)
def letter_table(spark, sf):
    """The full export of all hymns."""
    return nesting.letter_rows(hymns(spark, sf), verses(spark, sf))


@query()
def verse_documents(spark, sf):
    d = nesting.verse_documents(verses(spark, sf))
    return d.select("hymn_index", "verse_ord", F.to_json("document").alias("json"))


@query(
    f"WITH {V}, p AS (SELECT hymn_index, verse_ord, eng, lag(eng) OVER (PARTITION BY hymn_index ORDER BY verse_ord) AS before FROM v) SELECT hymn_index, verse_ord, levenshtein(eng, before)::INT AS distance FROM p WHERE eng IS NOT NULL AND before IS NOT NULL"
)
def verse_levenshtein(spark, sf):
    """Edit distance of each verse's gloss from the one before it."""
    v = verses(spark, sf).withColumn("before", F.lag("eng").over(W.partitionBy("hymn_index").orderBy("verse_ord")))
    return v.filter("eng is not null and before is not null").select("hymn_index", "verse_ord", F.levenshtein("eng", "before").alias("distance"))


@query(fold_sql.DOCUMENTS_READ)
def verse_documents_read(spark, sf):
    """The verse documents written as JSON and read back: lines, and how many words, letters, syllables and boundaries they hold."""
    d = nesting.verse_documents(verses(spark, sf)).select("hymn_index", "verse_ord", F.to_json("document").alias("json"))
    v = sinks.read_verse_json(d)
    total = lambda c, f: F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.size(f(x)), F.lit(0)))
    return v.select(
        "hymn_index", "verse_ord", F.col("verseNumber").alias("verse_number"), "dev", "iast", F.size("devWords").alias("words"), total("devWords", lambda w: w["letters"]).alias("letters"),
        total("devWords", lambda w: w["devSyllables"]).alias("syllables"), total("devWords", lambda w: w["alignment"]).alias("pairs"), F.size("iastWords").alias("roman_words"),
        total("iastWords", lambda w: w["iastSyllables"]).alias("roman_syllables"), F.size("sandhi").alias("boundaries"),
    )
