"""Tagged verse text: reading and cutting it into hymns and verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.functions import meter, text

ILLEGAL = '<>:"/\\|?*'


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_path (without scheme and host), text of *.txt files (extension without case), given by themselves or by folder, on any file system."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter="*.[tT][xX][tT]")
    return files.select(F.url_decode(F.regexp_replace("_metadata.file_path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?/+", "/")).alias("source_path"), F.col("value").alias("text"))


def export_base(path):
    """File stem, with characters that file systems refuse as underscores; nothing left gives Hymn."""
    stem = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^.*/", ""), r"\.[^.]*$", "")
    clean = F.translate(stem, ILLEGAL, "_" * len(ILLEGAL))
    return F.when(clean == "", "Hymn").otherwise(clean)


def lines(files: DataFrame, key: str) -> DataFrame:
    """key, n, line with its kind: the first recogniser that fits a line counts; metadata may stand anywhere in a line."""
    body = F.regexp_replace("text", r"\n$", "")
    l = files.filter("text is not null").select(F.col(key), F.posexplode(F.split(body, "\n")).alias("n", "line"))
    number = lambda tag: F.nullif(F.regexp_extract("line", tag + r":\s*(\d+)", 1), F.lit(""))
    has = lambda p: F.col("line").rlike(p)
    kind = (
        F.when(has(r"Mandala:\s*\d+"), "mandala").when(has(r"Sukta:\s*\d+"), "sukta").when(has("Rishis:"), "rishis").when(has("Devatas:"), "devatas")
        .when(has("Categories:"), "categories").when(has(r"\[Verse\s*\d+\]"), "verse").when(has("^DEV:"), "dev").when(has("^IAST:"), "iast").when(has("^ENG:"), "eng")
    )
    value = (
        F.when(kind == "mandala", number("Mandala")).when(kind == "sukta", number("Sukta")).when(kind == "rishis", F.regexp_extract("line", r"Rishis:\s*(.*)", 1))
        .when(kind == "devatas", F.regexp_extract("line", r"Devatas:\s*(.*)", 1)).when(kind == "categories", F.regexp_extract("line", r"Categories:\s*(.*)", 1))
        .when(kind == "verse", F.regexp_extract("line", r"\[Verse\s*(\d+)\]", 1)).when(kind == "dev", F.substring("line", 5, 1 << 30)).when(kind == "iast", F.substring("line", 6, 1 << 30))
        .when(kind == "eng", F.substring("line", 5, 1 << 30))
    )
    return l.select(key, "n", kind.alias("kind"), value.alias("value")).filter("kind is not null")


def hymns(parsed: DataFrame, key: str) -> DataFrame:
    """key, mandala, sukta (last one counts, 0 if none), rishis, devatas, categories (one element a line)."""
    last = lambda k: F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("n"))).try_cast("int"), F.lit(0))

    def many(k):
        got = F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "value"))))
        return F.transform(got, lambda x: x["value"])

    return parsed.groupBy(key).agg(last("mandala").alias("mandala"), last("sukta").alias("sukta"), many("rishis").alias("rishis"), many("devatas").alias("devatas"), many("categories").alias("categories"))


def verses(parsed: DataFrame, key: str) -> DataFrame:
    """key, verse_ord (from 0), verse_number, dev, iast, eng, dev_all, iast_all.

    A verse tag starts a new verse unless the number so far is 0 or missing: lines before the first tag, and those of a
    verse numbered 0, go on into the next verse. A repeated line replaces the text, while its words are added: dev_all
    and iast_all hold all lines' text for cutting words. Text keeps its leading space; numbers beyond 32 bits count as
    missing. One shuffle by file; a file's lines are one window.
    """
    order = W.partitionBy(key).orderBy("n")
    number = F.when(F.col("kind") == "verse", F.coalesce(F.col("value").try_cast("int"), F.lit(0)))
    p = parsed.filter("kind in ('verse', 'dev', 'iast', 'eng')").withColumn("number", number)
    before = F.coalesce(F.last("number", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("fresh", F.when((F.col("kind") == "verse") & (before != 0), 1).otherwise(0))
    p = p.withColumn("ord", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    of = lambda k: F.when(F.col("kind") == k, F.struct("n", "value"))
    last = lambda k: F.coalesce(F.max(of(k))["value"], F.lit(""))
    every = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(of(k))), lambda x: x["value"]), " ")
    v = p.groupBy(key, "ord").agg(
        F.max(F.when(F.col("kind") == "verse", F.struct("n", "number")))["number"].alias("verse_number"), last("dev").alias("dev"), last("iast").alias("iast"),
        last("eng").alias("eng"), every("dev").alias("dev_all"), every("iast").alias("iast_all"),
    ).filter("verse_number <> 0")
    place = F.row_number().over(W.partitionBy(key).orderBy("ord")) - 1
    return v.withColumn("verse_ord", place).select(key, "verse_ord", "verse_number", "dev", "iast", "eng", "dev_all", "iast_all")


def with_meters(verses: DataFrame) -> DataFrame:
    """Adds counts (of padas, joined) and meter; words are those of all lines of a verse."""
    v = verses.withColumn("_c", meter.pada_counts(F.col("dev"), F.col("iast"), F.col(text.line(verses, "iast"))))
    return v.withColumns({"counts": meter.format_counts(F.col("_c")), "meter": meter.detect(F.col("_c"))}).drop("_c")
