"""Queries p1, p2, p3, p4, p6, p7, p8 over the test tables, with production parameters and whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chandas.common import blank_trim, cut, latest, table

from . import contamination, knn, langid, lookalike, mixing, spans, terms

# The vector's components.
CLASSES = ["velar", "palatal", "retroflex", "dental", "labial", "semivowel", "liquid", "sibilant", "aspirate", "nasal", "vowel"]
SWARAS = ["udatta", "anudatta", "svarita"]


# p1 ------------------------------------------------------------------------------------------------------------------
def _count(m, name, plain):
    """A map's count for a name, keys compared without case and outer blanks; the exact spelling is looked up directly."""
    spelled = name if name in SWARAS else name.capitalize()
    slow = F.aggregate(
        F.filter(F.map_entries(m), lambda e: F.lower(blank_trim(e["key"])) == name), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["value"], F.lit(0)).cast("long")
    )
    return F.coalesce(F.when(plain, F.try_element_at(m, F.lit(spelled)).cast("long")).otherwise(slow), F.lit(0)).cast("double")


def verse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, vec: 11 class counts and 3 swara counts of each verse's current row."""
    t = table(spark, sf, "verse_analysis").filter("verse_id is not null")
    pc, sw = F.col("phoneme_class_frequency"), F.col("swara_frequency")
    plain = lambda m, names: F.forall(F.map_keys(m), lambda k: k.isin(*names))
    t = t.select(
        "verse_id", "exported_at", "phoneme_class_frequency", "swara_frequency",
        plain(pc, [c.capitalize() for c in CLASSES]).alias("pc_plain"), plain(sw, SWARAS).alias("sw_plain"),
    )
    vec = F.array(*[_count(pc, c, F.col("pc_plain")) for c in CLASSES], *[_count(sw, s, F.col("sw_plain")) for s in SWARAS])
    return latest(t.select(F.col("verse_id").alias("id"), "exported_at", vec.alias("vec")), ["id"], ["exported_at"], ["vec"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = cut(verse_vectors(spark, sf))  # read three times: by the fit, the index and the probes
    probes = table(spark, sf, "knn_probes").select(F.col("verse_id").alias("id")).distinct()
    near = knn.nearest(vectors, vectors.join(probes, "id", "left_semi"), 5)
    a, b = F.least("query_id", "neighbor_id"), F.greatest("query_id", "neighbor_id")
    return near.select(a.alias("verse_a"), b.alias("verse_b")).distinct()


def p1_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every verse whose id is divisible by 100, against all verses."""
    vectors = cut(verse_vectors(spark, sf))
    return knn.nearest(vectors, vectors.filter("id % 100 = 0"), 5)


def p1_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return knn.nearest(vectors, vectors.filter("id % 100 = 0"), 10).select("query_id", "neighbor_id", "rank")


# p2 ------------------------------------------------------------------------------------------------------------------
def line_values(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "verses").select(F.col("verse_id").alias("row_id"), F.expr("stack(2, 'dev', dev, 'iast', iast) as (field_name, value)"))
    s = table(spark, sf, "sandhi").select(F.col("boundary_id").alias("row_id"), F.lit("surface_iast").alias("field_name"), F.col("surface_iast").alias("value"))
    return v.unionByName(s)


def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonical(line_values(spark, sf)).select("field_name", "row_id", "value", "canonical").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = lookalike.canonical(line_values(spark, sf)).filter("odd AND value <> canonical")
    return found.select("field_name", "row_id").distinct()


# p3 ------------------------------------------------------------------------------------------------------------------
def line_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "verses").select(F.col("verse_id").alias("id"), F.expr("stack(2, 'dev', dev, 'iast', iast) as (field, text)"))


def p3_found(spark: SparkSession, sf: str, batches: int = 2) -> DataFrame:
    got = spans.shared_spans(line_records(spark, sf), batches=batches)
    return got.select(F.col("field").alias("field_name"), F.col("id").alias("verse_id"), "span_from", "span_to").distinct()


def p3_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """p3_found's rows from so many batches that runs are compacted, and the last batch is joined with a compacted run."""
    return p3_found(spark, sf, spans.FANOUT + 2)


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    records = line_records(spark, sf)
    return spans.coverage(records, spans.shared_spans(records))


# p4 ------------------------------------------------------------------------------------------------------------------
#: Characters that any text of them alone is in NFC.
_COMPOSED = r"^[\x{0}-\x{2FF}\x{904}-\x{928}\x{92A}-\x{930}\x{932}\x{933}\x{935}-\x{939}\x{93D}-\x{94C}\x{964}-\x{971}\x{1E00}-\x{1EFF}]*\z"


def _nfc(c):
    """NFC; only values that a look on the JVM side can't tell to be in it already are sent to Python."""
    send = F.when(~c.rlike(_COMPOSED), c)
    return F.coalesce(F.pandas_udf(lambda s: s.map({x: unicodedata.normalize("NFC", x) for x in s.dropna().unique()}), "string")(send), c)


def analysis_current(spark: SparkSession, sf: str) -> DataFrame:
    """export_base, type, key, value: the current rows, with the standard spelling of type and key."""
    kind = F.lower(blank_trim(F.col("feat_type")))
    t = table(spark, sf, "analysis").select(
        "export_base", "feat_value", "exported_at", "received_at", blank_trim(F.col("feat_key")).alias("key"),
        F.when(kind == "letter", "Letter").when(kind == "swara", "Swara").when(kind == "phonemeclass", "PhonemeClass").alias("type"),
    ).filter("export_base is not null and type is not null and key is not null").withColumn("key", _nfc(F.col("key")))
    return latest(t, ["export_base", "type", "key"], ["exported_at", "received_at"], ["feat_value"]).withColumnRenamed("feat_value", "value")


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.transform(F.map_entries("letter_frequency"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    t = table(spark, sf, "verse_analysis").filter("verse_id is not null").select("verse_id", "exported_at", F.array_sort(entries).alias("entries"))
    return latest(t, ["verse_id"], ["exported_at"], ["entries"])


def term_records(spark: SparkSession, sf: str) -> DataFrame:
    """term_set, record, terms, weights for the three term sets, each term of a record by itself; only counts above 0 occur."""
    some = _letters(spark, sf).select(F.col("verse_id").alias("record"), F.filter("entries", lambda e: e["v"] > 0).alias("e"))
    one = some.select(F.lit("letter").alias("term_set"), "record", F.col("e.k").alias("terms"), F.col("e.v").cast("array<bigint>").alias("weights"))
    now = analysis_current(spark, sf).filter("value > 0").select(F.xxhash64("export_base").alias("record"), "type", "key", "value")
    pairs = F.array(
        F.struct(F.lit("key").alias("term_set"), F.array(F.concat_ws(":", "type", "key")).alias("terms"), F.array("value").alias("weights")),
        F.struct(F.lit("value").alias("term_set"), F.array(F.col("value").cast("string")).alias("terms"), F.array(F.lit(1).cast("long")).alias("weights")),
    )
    return one.unionByName(now.select("record", F.inline(pairs)))


def most_records(spark: SparkSession, sf: str) -> int:
    """A bound on the records of any term set: the rows of the larger table (from the files' footers)."""
    return max(table(spark, sf, "verse_analysis").count(), table(spark, sf, "analysis").count())


def term_totals(spark: SparkSession, sf: str) -> DataFrame:
    verses = table(spark, sf, "verse_analysis").agg(F.countDistinct("verse_id").alias("records")).select(F.explode(F.array(F.lit("letter"))).alias("term_set"), "records")
    exports = table(spark, sf, "analysis").agg(F.countDistinct("export_base").alias("records")).select(F.explode(F.array(F.lit("key"), F.lit("value"))).alias("term_set"), "records")
    return verses.unionByName(exports)


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = terms.ngram_counts(term_records(spark, sf), 1, most_records(spark, sf)).select("term_set", F.col("ngram")[0].alias("term"), "cf", "df")
    return terms.verdicts(counts, term_totals(spark, sf)).select("term_set", "term", "cf", "df", "verdict")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_counts(spark, sf).filter("verdict in ('rare', 'common')").select("term_set", "term", "verdict").distinct()


def p4_word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all runs of 1 to 3 words of the verses' Roman lines."""
    words = F.filter(F.split("iast", r"[ \t\n\r\x0B\f|।॥]+"), lambda x: x != "")
    t = table(spark, sf, "verses").filter("verse_id is not null").groupBy("verse_id").agg(F.max("iast").alias("iast"))
    records = t.select(F.lit("iast").alias("term_set"), F.col("verse_id").alias("record"), words.alias("terms"))
    records = records.withColumn("weights", F.array_repeat(F.lit(1).cast("long"), F.size("terms"))).filter("terms is not null")
    return terms.ngram_counts(records, 3, table(spark, sf, "verses").count()).select(F.array_join("ngram", " ").alias("ngram"), "cf", "df")


# p6 ------------------------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.clean(table(spark, sf, "documents"), table(spark, sf, "eval_items")).filter("removed_chars > 0")


# p7 ------------------------------------------------------------------------------------------------------------------
def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", mixing.byte_tokens(F.col("text")).alias("tokens"))
    return mixing.Mix(records, table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report().filter("not reachable").select("source").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).plan()


# p8 ------------------------------------------------------------------------------------------------------------------
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    got = langid.relabel(docs, langid.fit(table(spark, sf, "lang_samples"))).filter("wrong")
    return got.select("doc_id", F.explode("langs").alias("true_lang")).distinct()


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    got = langid.relabel(docs, langid.fit(table(spark, sf, "lang_samples")))
    return got.select("doc_id", "stored_code", F.array_join("langs", ",").alias("langs"), "main", F.round("confidence", 6).alias("confidence"), "wrong")


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    return langid.stretches(table(spark, sf, "documents"), langid.fit(table(spark, sf, "lang_samples")))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_knn, p1_embeddings, p2_found, p2_canonical, p3_found, p3_compacted, p3_coverage, p4_found, p4_counts, p4_word_ngrams,
        p6_found, p6_report, p6_clean, p7_found, p7_report, p7_plan, p8_found, p8_labels, p8_segments,
    )
}
