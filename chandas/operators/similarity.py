"""Scores between verses or hymns from sparse feature counts.

Features are (owner, kind, key, value) rows. Pairs come from a join on the group (all verses of one hymn, or a
selection); only keys that both sides have meet, totals are added per side, so zero-overlap pairs keep their row.

A large selection has no group to join on: its owners are dealt to blocks by hash, each pair of blocks is one job, and
a job multiplies matrices of the keys that both sides have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chandas.common import shuffle_partitions
from chandas.functions import vectors

SCORES = ["dot_product", "magnitude_a", "magnitude_b", "cosine_similarity", "confidence"]
#: Blocks of a selection; a profile is sent to as many jobs, of which there are BLOCKS * (BLOCKS + 1) / 2.
BLOCKS = 16
#: Owners of either side whose pairs are scored at a time, and keys of a multiplication.
TILE, KEYS = 256, 4096


def profile(features: DataFrame, owner: list[str]) -> DataFrame:
    """owner, kind, values (map of key to value), total, squares, size: one row for each owner and kind."""
    return features.groupBy(*owner, "kind").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.col("value").cast("double")))).alias("values"),
        F.sum(F.abs("value")).cast("double").alias("total"), F.sum(F.col("value") * F.col("value")).cast("double").alias("squares"), F.count(F.lit(1)).alias("size"),
    )


def _score(a: str, b: str):
    """Scores of two profiles' columns (prefixes a and b); a missing profile is an empty one."""
    col = lambda p, c, empty: F.coalesce(F.col(f"{p}.{c}"), F.lit(empty))
    av, bv = F.col(f"{a}.values"), F.col(f"{b}.values")
    keys = F.coalesce(F.filter(F.map_keys(av), lambda k: F.map_contains_key(bv, k)), F.array().cast("array<string>"))
    dot = F.aggregate(keys, F.lit(0.0), lambda s, k: s + av[k] * bv[k])
    ma, mb = F.sqrt(col(a, "squares", 0.0)), F.sqrt(col(b, "squares", 0.0))
    shared = F.size(keys)
    active = col(a, "size", 0) + col(b, "size", 0) - shared
    conf = vectors.confidence(shared, active, col(a, "total", 0.0), col(b, "total", 0.0))
    return [dot, ma, mb, vectors.cosine(dot, ma, mb), conf]


def _wide(profiles: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    return profiles.groupBy(*keys).agg(*[F.first(F.when(F.col("kind") == k, F.struct("values", "total", "squares", "size")), ignorenulls=True).alias(k) for k in kinds])


def pairs(profiles: DataFrame, group: list[str], owner: str, kinds: list[str], carry: list[str] = ()) -> DataFrame:
    """Scores for all pairs of owners a < b of a group. One row a pair; columns `<kind>_<score>`.

    All kinds of an owner are first brought into one row; the join is on the group (a hymn's verses are few), so work
    is the size of the output. Keys with value 0 must not be in the features.
    """
    wide = _wide(profiles, [*group, owner, *carry], kinds)
    a, b = wide.alias("a"), wide.alias("b")
    cond = F.col(f"a.{owner}") < F.col(f"b.{owner}")
    for g in group:
        cond = (F.col(f"a.{g}") == F.col(f"b.{g}")) & cond
    out = [*[F.col(f"a.{g}").alias(g) for g in group], *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in [owner, *carry] for s in "ab"]]
    for k in kinds:
        out += [x.alias(f"{k}_{n}") for x, n in zip(_score(f"a.{k}", f"b.{k}"), SCORES)]
    return a.join(b, cond).select(*out)


def _round(x, decimals: int | None):
    """Half away from zero, of the scaled value as it is."""
    if decimals is None:
        return x
    y = x * 10.0**decimals
    t = np.trunc(y)
    return (t + np.sign(y) * (np.abs(y - t) >= 0.5)) / 10.0**decimals


class _Kind:
    """Profiles of one kind as flat entries: row, code of the key, value."""

    def __init__(self, table: pa.Table, kind: str):
        col = lambda c: table[f"{kind}_{c}"].combine_chunks()
        keys = col("keys")
        self.size = pc.list_value_length(keys).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.codes = keys.flatten().dictionary_encode().indices.to_numpy()
        self.values = col("values").flatten().to_numpy()
        self.total, self.magnitude = col("total").to_numpy(), np.sqrt(col("squares").to_numpy())

    def entries(self, rows):
        n = self.size[rows]
        at = np.arange(n.sum()) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(rows)), n), self.codes[at], self.values[at]

    def scores(self, a, b, decimals):
        """dot_product, cosine_similarity, confidence of rows a with rows b, as matrices."""
        ea, eb = self.entries(a), self.entries(b)
        both = np.intersect1d(ea[1], eb[1])
        dot, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for k in range(0, len(both), KEYS):
            x, y = _dense(*ea, both[k : k + KEYS], len(a)), _dense(*eb, both[k : k + KEYS], len(b))
            dot += x @ y.T
            shared += (x != 0).astype(float) @ (y != 0).astype(float).T
        m = self.magnitude[a][:, None] * self.magnitude[b]
        ta, tb, active = self.total[a][:, None], self.total[b], self.size[a][:, None] + self.size[b] - shared
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(m == 0, 0.0, dot / m)
            conf = (shared / active + np.minimum(ta, tb) / np.maximum(ta, tb) + np.minimum(1.0, active / vectors.FULL_DIMENSIONS)) / 3
        conf = np.where((active > 0) & (ta != 0) & (tb != 0), conf, 0.0)
        return [_round(x, decimals) for x in (dot, cosine, conf)]


def _dense(rows, codes, values, keys, n: int):
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    hit = keys[at] == codes
    out = np.zeros((n, len(keys)))
    out[rows[hit], at[hit]] = values[hit]
    return out


def _block_pairs(owner: str, kinds: list[str], carry: list[str], decimals: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        block, low, high = (t[c].to_numpy() for c in ("_block", "_low", "_high"))
        own, shown = t[owner].to_numpy(), [t[c].combine_chunks() for c in (owner, *carry)]
        profiles = [_Kind(t, k) for k in kinds]
        magnitudes = [_round(p.magnitude, decimals) for p in profiles]

        def batch(a, b, scores, at):
            cols = [c.take(pa.array(rows)) for c in shown for rows in (a, b)]
            for m, (dot, cosine, conf) in zip(magnitudes, scores):
                cols += map(pa.array, (dot[at], m[a], m[b], cosine[at], conf[at]))
            return pa.RecordBatch.from_arrays(cols, names=names)

        names = _names(owner, kinds, carry)
        tiles = lambda rows: [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
        for a in tiles(np.nonzero(block == low)[0]):
            for b in tiles(np.nonzero(block == high)[0]):
                scores = [p.scores(a, b, decimals) for p in profiles]
                x, y = np.nonzero(own[a][:, None] < own[b])
                if len(x):
                    yield batch(a[x], b[y], scores, (x, y))
                if low[0] != high[0]:  # within a block the other order comes up by itself
                    x, y = np.nonzero(own[a][:, None] > own[b])
                    if len(x):
                        yield batch(b[y], a[x], scores, (x, y))

    return run


def _names(owner: str, kinds: list[str], carry: list[str]) -> list[str]:
    return [*[f"{c}_{s}" for c in (owner, *carry) for s in "ab"], *[f"{k}_{n}" for k in kinds for n in SCORES]]


def selection_pairs(profiles: DataFrame, owner: str, kinds: list[str], carry: list[str] = (), decimals: int | None = None) -> DataFrame:
    """Scores for all pairs of owners a < b of one selection of any size, in the columns of `pairs`; rounded if decimals are given.

    Work and rows are the square of the owners, spread over the pairs of blocks. A task holds the profiles of two blocks
    and the scores of a tile. Keys with value 0 must not be in the features.
    """
    some = lambda k, c: F.coalesce(F.col(f"{k}.{c}"), F.lit(0.0)).alias(f"{k}_{c}")
    none = {"keys": F.array().cast("array<string>"), "values": F.array().cast("array<double>")}
    flat = _wide(profiles, [owner, *carry], kinds).filter(F.col(owner).isNotNull()).select(
        owner, *carry, F.pmod(F.xxhash64(owner), F.lit(BLOCKS)).cast("int").alias("_block"),
        *[F.coalesce(f(f"{k}.values"), none[c]).alias(f"{k}_{c}") for k in kinds for c, f in (("keys", F.map_keys), ("values", F.map_values))],
        *[some(k, c) for k in kinds for c in ("total", "squares")],
    )
    sent = flat.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    sent = sent.withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")}).drop("_other")
    kind_of = [flat.schema[c].dataType for c in (owner, *carry) for _ in "ab"] + [T.DoubleType()] * len(SCORES) * len(kinds)
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_names(owner, kinds, carry), kind_of)])
    jobs = sent.repartition(shuffle_partitions(profiles.sparkSession), "_low", "_high").groupBy("_low", "_high")
    return jobs.applyInArrow(_block_pairs(owner, kinds, carry, decimals), schema)


def arrays(df: DataFrame, a: str, b: str) -> DataFrame:
    """Scores of two array columns, added to a frame."""
    x, y = F.col(a), F.col(b)
    d, ma, mb = vectors.dot(x, y), vectors.magnitude(x), vectors.magnitude(y)
    return df.withColumns(dict(zip(SCORES, [d, ma, mb, vectors.cosine(d, ma, mb), vectors.array_confidence(x, y)])))
