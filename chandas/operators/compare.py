"""Features of verses and hymns, and comparison of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.functions import syllables, text

from . import frequency, similarity

KINDS = ["phoneme", "swara", "meter"]


def features(verses: DataFrame, keys: list[str], meter: bool = True) -> DataFrame:
    """keys, kind, key, value: sound class, accent and place:weight counts. `keys` may be coarser than a verse (rows add up).

    Letters and syllables are exploded once each; both sides are summed on the map side.
    """
    units = frequency.unit_counts(verses, keys)
    both = F.array(
        F.struct(F.lit("phoneme").alias("kind"), F.nullif(frequency.P.phoneme_class(F.substring("unit", 1, 1)), F.lit("Other")).alias("key")),
        F.struct(F.lit("swara").alias("kind"), frequency.P.swara_of_unit(F.col("unit")).alias("key")),
    )
    out = units.select(*keys, "n", F.inline(both)).filter("key is not null").groupBy(*keys, "kind", "key").agg(F.sum("n").alias("value"))
    if not meter:
        return out
    w = verses.select(*keys, F.posexplode_outer(syllables.line_weights(text.words(text.line(verses, "dev")))).alias("place", "weight")).filter("weight is not null")
    places = w.select(*keys, F.lit("meter").alias("kind"), F.concat_ws(":", F.col("place") + 1, "weight").alias("key"))
    return out.unionByName(places.groupBy(*keys, "kind", "key").agg(F.count(F.lit(1)).alias("value")))


def verse_pairs(verses: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """All pairs of verses of one hymn, in order. verses: hymn_index, verse_ord, verse_number, dev.

    Verses without any letter still pair up, with scores 0.
    """
    f = features(verses, ["hymn_index", "verse_ord", "verse_number"], "meter" in kinds)
    none = verses.select("hymn_index", "verse_ord", "verse_number", F.lit("none").alias("kind"), F.lit("").alias("key"), F.lit(1).cast("long").alias("value"))
    p = similarity.profile(f.unionByName(none), ["hymn_index", "verse_ord", "verse_number"])
    return similarity.pairs(p, ["hymn_index"], "verse_ord", kinds, ["verse_number"])


def resolve_verses(hymns: DataFrame, verses: DataFrame, references: list[tuple[int, int]]) -> DataFrame:
    """sel_ord, hymn_index, verse_ord, verse_number, dev of (hymn, verse number) references; the first verse of a number counts.

    References that name nothing give no row; repeated references stay.
    """
    spark = verses.sparkSession
    sel = spark.createDataFrame([(i, h, v) for i, (h, v) in enumerate(references)], "sel_ord int, hymn_index int, verse_number int")
    first = W.partitionBy("sel_ord").orderBy("verse_ord")
    got = verses.join(F.broadcast(sel), ["hymn_index", "verse_number"])  # as many rows as references were typed
    got = got.withColumn("_n", F.row_number().over(first)).filter("_n = 1").join(hymns.select("hymn_index", "export_base"), "hymn_index", "left")
    return got.select("sel_ord", "hymn_index", "export_base", "verse_ord", "verse_number", "dev", *[c for c in ("dev_all",) if c in verses.columns])


def compare_verses(selected: DataFrame) -> DataFrame:
    """Pairs i < j of a selection (sel_ord, dev, ...), across hymns too, with all scores."""
    f = features(selected, ["sel_ord"])
    none = selected.select("sel_ord", F.lit("none").alias("kind"), F.lit("").alias("key"), F.lit(1).cast("long").alias("value"))
    return similarity.pairs(similarity.profile(f.unionByName(none), ["sel_ord"]).withColumn("all", F.lit(0)), ["all"], "sel_ord", KINDS).drop("all")


def compare_hymns(verses: DataFrame, decimals: int | None = None) -> DataFrame:
    """Pairs of the hymns whose verses are given (a selection of any size), with scores of their summed features and their numbers of verses."""
    n = verses.groupBy("hymn_index").agg(F.count(F.lit(1)).alias("verses"))
    f = features(verses, ["hymn_index"])
    none = n.select("hymn_index", F.lit("none").alias("kind"), F.lit("").alias("key"), F.lit(1).cast("long").alias("value"))
    p = similarity.profile(f.unionByName(none), ["hymn_index"]).join(n, "hymn_index")
    return similarity.selection_pairs(p, "hymn_index", KINDS, ["verses"], decimals)
