"""Adding hymn files as they arrive: a file stream, parsed batch by batch into partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chandas.functions import text
from chandas.functions import phonology as P
from chandas.sources import tagged


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """source_path, text of each new *.txt file, once."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    return files.select(F.url_decode(F.regexp_replace("_metadata.file_path", "^file:/+", "/")).alias("source_path"), F.col("value").alias("text"))


def parse_batch(files: DataFrame) -> DataFrame:
    return tagged.with_meters(tagged.verses(tagged.lines(files, "source_path"), "source_path")).drop("counts")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True):
    """Streaming query that appends the verses of new files to `out`. A batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        parse_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = file_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def class_counts(verses: DataFrame, time: str, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Sound class counts of a stream of verses by window of `time`; rows later than `delay` are left out."""
    units = F.flatten(F.transform(text.words("dev"), P.dev_values))
    e = verses.withWatermark(time, delay).select(F.window(time, window).alias("window"), F.explode(units).alias("letter"))
    return e.groupBy("window", P.phoneme_class(F.col("letter")).alias("phoneme_class")).agg(F.count(F.lit(1)).alias("n"))
