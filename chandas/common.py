"""Small helpers shared by all operators: table access, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a session in one process may do without and gets its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"chandas-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/chandas/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: White space, as a class for regular expressions; zero-width characters are not white space.
WHITE = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def blank_trim(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def latest(df: DataFrame, keys: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """One row for each key: of the rows with the greatest `by`, nulls lowest; equal `by` is settled by `keep` itself.

    Map-side combined; a hot key never gathers its rows in one task.
    """
    value = F.struct(*[F.col(c) for c in keep])
    best = F.max_by(value, F.struct(*[F.col(c) for c in by], value)).alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in keep])
