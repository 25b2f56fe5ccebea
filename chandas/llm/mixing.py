"""Mixing sources to target weights by hash-threshold histograms.

Each record has a 60-bit hash of its id (the first 15 digits of its MD5, which any engine has). Tokens are summed by source and the hash's leading bits; running sums over
that histogram (bounded: sources x 2**LEVEL_BITS rows) give, for each source, the bucket in which its budget ends.
Only the records of that bucket are looked at again, by the next bits, until a bucket holds single records. The result
is one threshold per source: a record is taken `copies` times, or once more if its hash lies below the threshold.
Thresholds are nested: a larger budget keeps every record a smaller one took. No sort of the records, no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.common import cut

LEVEL_BITS = 10
HASH_BITS = 60
#: Upper bound on the rows of the target table for which per-source facts are broadcast.
MAX_TARGETS = 100_000


def standard_source(c: Column) -> Column:
    """Lower case, no outer white space, one underscore for each run of white space, hyphens and underscores."""
    inner = F.regexp_replace(F.lower(c), r"^[\s ]+|[\s ]+$", "")
    return F.regexp_replace(inner, r"[\s _\-]+", "_")


def byte_tokens(c: Column) -> Column:
    """Tokens of the byte-level tokenizer without end mark: one for each UTF-8 byte; null text has none."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _prefix(c: Column, bits: int) -> Column:
    return F.shiftright(c, HASH_BITS - bits)


class Mix:
    """Targets applied to records. Null or unknown sources take no part; a null share or repeat limit counts as 0.

    records: id, source (raw spelling), tokens. targets: source, target_share, max_repeats (one row a source; of
    repeated rows the greatest share and limit count). budget_share: part of all matched tokens that is to be built.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, budget_share: float = 0.5):
        t = targets.select(
            standard_source(F.col("source")).alias("source"),
            F.coalesce(F.col("target_share"), F.lit(0.0)).cast("double").alias("target_share"),
            F.coalesce(F.col("max_repeats"), F.lit(0)).cast("long").alias("max_repeats"),
        ).filter(F.col("source").isNotNull())
        self.targets = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        small = self.targets.limit(MAX_TARGETS + 1).count() <= MAX_TARGETS
        self._hint = F.broadcast if small else (lambda d: d)
        rows = records.select(
            F.col("id").alias("id"),
            standard_source(F.col("source")).alias("source"),
            F.col("tokens").cast("long").alias("tokens"),
            F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
        ).filter(F.col("source").isNotNull())
        self.rows = rows.join(self._hint(self.targets.select("source")), "source", "left_semi")
        self.budget_share = budget_share
        self._histogram: DataFrame | None = None

    def histogram(self) -> DataFrame:
        """source, bucket, tokens, records by the hash's leading bits; written once, of bounded size."""
        if self._histogram is None:
            by = self.rows.groupBy("source", _prefix(F.col("h"), LEVEL_BITS).alias("bucket"))
            self._histogram = cut(by.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records")))
        return self._histogram

    def budgets(self) -> DataFrame:
        """One row a target source: tokens there are, wanted, full copies, remainder, reachable."""
        have = self.histogram().groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("records").alias("records"))
        total = have.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(self.budget_share))).alias("budget"))
        out = self.targets.join(have, "source", "left").na.fill(0, ["tokens", "records"]).join(F.broadcast(total))
        out = out.withColumn("wanted", F.col("target_share") * F.col("budget"))
        out = out.withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("wanted"))
        full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("wanted") / F.col("tokens")), F.col("max_repeats"))).otherwise(F.lit(0))
        out = out.withColumn("copies", full.cast("long"))
        rest = F.when(F.col("copies") < F.col("max_repeats"), F.col("wanted") - F.col("copies") * F.col("tokens")).otherwise(F.lit(0.0))
        return out.withColumn("rest", rest)

    def thresholds(self) -> DataFrame:
        """source, copies, below (hash under which a record is taken once more): refined level by level."""
        b = self.budgets().select("source", "copies", "rest")
        hist, bits = self.histogram().select("source", "bucket", "tokens"), LEVEL_BITS
        state = cut(self._boundary(hist, b.withColumn("spent", F.lit(0.0))))
        while bits < HASH_BITS:
            # only the records of each source's boundary bucket are read again
            inside = self.rows.join(self._hint(state.select("source", "bucket")), "source").filter(_prefix(F.col("h"), bits) == F.col("bucket"))
            bits += LEVEL_BITS
            fine = inside.groupBy("source", _prefix(F.col("h"), bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
            fine = cut(fine)
            single = fine.agg(F.max("n")).first()[0]
            # a source whose budget ends at a bucket's edge has no boundary record; it keeps its edge, in finer units
            edge = state.withColumn("bucket", F.shiftleft(F.col("bucket"), LEVEL_BITS))
            found = self._boundary(fine, state.drop("bucket"))
            state = cut(
                edge.alias("e").join(found.alias("f"), "source", "left").select(
                    "source", F.col("e.copies").alias("copies"), F.col("e.rest").alias("rest"),
                    F.coalesce(F.col("f.spent"), F.col("e.spent")).alias("spent"), F.coalesce(F.col("f.bucket"), F.col("e.bucket")).alias("bucket"),
                )
            )
            if single is None or single <= 1:
                break
        return state.select("source", "copies", F.shiftleft(F.col("bucket"), HASH_BITS - bits).alias("below"))

    @staticmethod
    def _boundary(hist: DataFrame, state: DataFrame) -> DataFrame:
        """The first bucket whose tokens no longer fit, and what was spent before it. At most 2**LEVEL_BITS rows a source."""
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        h = state.join(hist, "source", "left").withColumn("sum", F.col("spent") + F.sum("tokens").over(run))
        fits = F.col("bucket").isNotNull() & (F.col("sum") <= F.col("rest"))
        past = F.min(F.when(~fits, F.col("bucket")))
        last = F.max(F.col("bucket")) + 1
        return h.groupBy("source", "copies", "rest").agg(
            F.max(F.when(fits, F.col("sum")).otherwise(F.col("spent"))).alias("spent"),
            F.coalesce(past, last, F.lit(0)).cast("long").alias("bucket"),
        )

    def plan(self) -> DataFrame:
        """id, source, tokens, copies >= 1: how often each record is used."""
        t = self.thresholds().withColumnRenamed("copies", "full")
        taken = F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
        return self.rows.join(self._hint(t), "source").select("id", "source", "tokens", taken.cast("int").alias("copies")).filter("copies > 0")

    def report(self) -> DataFrame:
        """source, target_share, actual_share, tokens, used_tokens, reachable; sources without records have share 0."""
        used = self.plan().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
        b = self.budgets().join(used, "source", "left").na.fill(0, ["used_tokens"])
        all_used = used.agg(F.sum("used_tokens").alias("all_used"))
        return b.join(F.broadcast(all_used)).select(
            "source", "target_share", F.coalesce(F.col("used_tokens") / F.col("all_used"), F.lit(0.0)).alias("actual_share"), "tokens", "used_tokens", "reachable"
        )
