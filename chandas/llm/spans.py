"""Long exact spans shared between records: a log-structured index of window fingerprints.

Of all windows of `length` code points, each window's fingerprint is the least hash among the `gram`-grams inside it
(so equal windows have equal fingerprints, and neighbours mostly share theirs). A batch's distinct fingerprints with
the least and greatest record id that has them form one immutable run: a table bucketed and sorted by fingerprint in
the shared folder. A new batch's run is merge-joined with the historical runs (bucketed alike: no shuffle); where a
fingerprint has two record ids, windows with it are candidates. Candidates are verified by a 64-bit and a 32-bit hash
of the whole window over all records that hold it, and found stretches are joined.

Runs have levels. FANOUT runs of a level are merged, by merge joins, into one of the next, and deleted; so a
fingerprint is written once for each level, and levels grow with the logarithm of the batches.

Shared fingerprints don't leave the executors one by one: the scan that emits candidate windows carries a bit map in
which they are marked, of a size that follows their number up to MOST_BITS; wrong bits only cost work, as every window
is verified. Beyond that, candidate windows are joined with the fingerprints instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.common import cut, scratch, shuffle_partitions

LENGTH, GRAM, FANOUT = 60, 40, 4
#: Size of the bit map of shared fingerprints: 128 KB at least, 32 MB at most; bits for each fingerprint.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 16


def _mix(x):
    import numpy as np

    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, base: int):
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    import numpy as np

    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * np.uint64(step)
        have += m
        step = step * step % 2**64 if have == 2 * m else pow(base, have, 2**64)
    return out


def _windows(codes, size: int, base: int):
    """Hash of every run of `size` numbers."""
    import numpy as np

    inverse = pow(base, -1, 2**64)
    n = len(codes)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _powers(n, base), out=pre[1:])
    return _mix((pre[size:] - pre[:-size]) * _powers(n + 1 - size, inverse))


def _least(a, width: int):
    """Minimum of every `width` neighbours."""
    import numpy as np

    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return a if have == width else np.minimum(a[: len(a) - (width - have)], a[width - have :])


#: Code points hashed at a time.
CHUNK = 2_000_000


def _chunks(ids, fields, texts, length: int):
    """Records of at least `length` code points, a bounded number of code points at a time; longer ones by themselves."""
    block, n = [], 0
    for i, f, t in zip(ids, fields, texts):
        if t is None or i is None or len(t) < length:
            continue
        block.append((i, f, t))
        n += len(t)
        if n >= CHUNK:
            yield block
            block, n = [], 0
    if block:
        yield block


def _scan(block, length: int, gram: int):
    """Arrays for all whole windows: record's number in the block, start, fingerprint; and the code points."""
    import numpy as np

    sizes = np.array([len(t) for _, _, t in block], np.int64)
    text = "".join(t for _, _, t in block)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = _mix(codes + np.uint64(0x9E3779B97F4A7C15))
    least = _least(_windows(codes, gram, 0x5851F42D4C957F2D), length - gram + 1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = sizes - length + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(whole)[:-1]]), whole) + np.arange(whole.sum())
    record = np.repeat(np.arange(len(block)), whole)
    return record, at - starts[record], least[at], codes, at


def _seed(block, record, least):
    """A field's own fingerprints."""
    import numpy as np

    names = sorted({f for _, f, _ in block})
    salt = {f: np.uint64(sum(b * 257**i for i, b in enumerate(f.encode())) % 2**63) for f in names}
    return _mix(least ^ np.array([salt[f] for _, f, _ in block], np.uint64)[record])


def _fingerprints(length: int, gram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block in _chunks(*(b.column(i).to_pylist() for i in range(3)), length):
                record, _, least, _, _ = _scan(block, length, gram)
                first = np.ones(len(least), bool)
                first[1:] = (least[1:] != least[:-1]) | (record[1:] != record[:-1])
                record, least = record[first], least[first]
                ids = np.array([i for i, _, _ in block], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_seed(block, record, least).view(np.int64)), pa.array(ids[record])], names=["fp", "id"])

    return run


def _candidates(length: int, gram: int, bitmap):
    """One row a record with candidates: their starts and two hashes. bitmap None: all windows, with their fingerprints."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        kind = [("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("fp", pa.int64())][: 4 if bits is None else 3]
        for b in batches:
            for block in _chunks(*(b.column(i).to_pylist() for i in range(3)), length):
                record, start, least, codes, at = _scan(block, length, gram)
                fp = _seed(block, record, least)
                if bits is not None:
                    slot = fp % np.uint64(len(bits) * 64)
                    hit = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    record, start, at, fp = record[hit], start[hit], at[hit], fp[hit]
                one = _seed(block, record, _windows(codes, length, 0x2545F4914F6CDD1D)[at])
                two = _windows(codes, length, 0xD1342543DE82EF95)[at]
                first = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]])) if len(record) else np.zeros(0, np.int64)
                columns = [start.astype(np.int32), one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), fp.view(np.int64)]
                flat = pa.StructArray.from_arrays([pa.array(c) for c, _ in zip(columns, kind)], fields=[pa.field(*f) for f in kind])
                windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(record)).astype(np.int32)), flat)
                holders = record[first]
                yield pa.RecordBatch.from_arrays([pa.array([block[i][1] for i in holders], pa.string()), pa.array([block[i][0] for i in holders], pa.int64()), windows], names=["field", "id", "windows"])

    return run


FP = "fp long, id long"
CAND = "field string, id long, windows array<struct<start: int, h1: long, h2: int{fp}>>"


class SpanIndex:
    """Runs of fingerprints of everything added so far. records: id long, field string, text string.

    Null ids and texts, and texts shorter than `length`, take no part. Rows repeated under one id never match each
    other. Extra columns are ignored. drop() deletes the runs; what add() and verify() gave stays readable.
    """

    def __init__(self, spark, length: int = LENGTH, gram: int = GRAM, path: str | None = None):
        if not 0 < gram <= length:
            raise ValueError("0 < gram <= length")
        self.spark, self.length, self.gram = spark, length, gram
        self.path = path or scratch(spark, "spans")
        self.parts = shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> str:
        """One immutable run: bucketed and sorted by fingerprint."""
        name = f"span_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.parts, "fp").sortBy("fp").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _delete(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        jvm, at = self.spark._jvm, f"{self.path}/{run}"
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _run(self, records: DataFrame) -> str:
        fps = records.select("id", "field", "text").mapInArrow(_fingerprints(self.length, self.gram), FP)
        return self._write(fps.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).repartition(self.parts, "fp"))

    def add(self, records: DataFrame) -> DataFrame:
        """Index a batch; returns the fingerprints that are now shared and involve the batch (fp), checkpointed."""
        new = self._run(records)
        shared = self.spark.table(new).filter("lo <> hi").select("fp")
        for run in self.runs:
            old, fresh = self.spark.table(run).alias("o"), self.spark.table(new).alias("n").hint("merge")
            two = F.least("o.lo", "n.lo") != F.greatest("o.hi", "n.hi")
            shared = shared.unionAll(old.join(fresh, F.col("o.fp") == F.col("n.fp")).filter(two).select(F.col("n.fp").alias("fp")))
        shared = cut(shared)  # runs may go from here on
        self._keep(new, 0)
        return shared

    def _keep(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merged = self.compact(self.levels[level])
            self.levels[level] = []
            self._keep(merged, level + 1)

    def compact(self, runs: list[str]) -> str:
        """Merge runs into a new one and delete them. Bucketed and sorted alike, they need no shuffle."""
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            a, b = merged.alias("a"), self.spark.table(run).alias("b").hint("merge")
            merged = a.join(b, "fp", "full").select("fp", F.least("a.lo", "b.lo").alias("lo"), F.greatest("a.hi", "b.hi").alias("hi"))
        new = self._write(merged)
        for run in runs:
            self._delete(run)
        return new

    def drop(self) -> None:
        for run in self.runs:
            self._delete(run)
        self.levels = []

    def _bitmap(self, shared: DataFrame):
        """Shared fingerprints as bits, at most MOST_BITS; None where they are too many for that."""
        import numpy as np

        wanted = BITS_EACH * shared.count()
        if wanted > MOST_BITS:
            return None
        bits = LEAST_BITS
        while bits < wanted:
            bits *= 2
        slot = F.col("fp").bitwiseAND(bits - 1)
        bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
        rows = shared.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        got = rows.toPandas()
        out = np.zeros(bits // 64, np.int64)
        out[got["word"].to_numpy()] = got["bits"].to_numpy()
        return self.spark.sparkContext.broadcast(out.tobytes())

    def verify(self, records: DataFrame, shared: DataFrame) -> DataFrame:
        """field, id, span_from, span_to: joined stretches of windows that another record holds verbatim."""
        bitmap = self._bitmap(shared)
        found = cut(records.select("id", "field", "text").mapInArrow(_candidates(self.length, self.gram, bitmap), CAND.format(fp=", fp: long" if bitmap is None else "")))
        windows = found.select("field", "id", F.inline("windows"))
        if bitmap is None:
            windows = windows.join(shared.distinct(), "fp", "left_semi")
        # summed up on the map side first: a window held by a third of all records sends a row a task, not a row a record
        two = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("h1", "h2")
        held = windows.join(two, ["h1", "h2"], "left_semi")
        order = W.partitionBy("field", "id").orderBy("start")
        fresh = F.coalesce(F.col("start") > F.lag("start").over(order) + self.length, F.lit(True)).cast("int")
        numbered = held.select("field", "id", "start").withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order))
        ends = numbered.groupBy("field", "id", "n").agg(F.min("start").alias("span_from"), (F.max("start") + self.length).alias("span_to"))
        return ends.select("field", "id", "span_from", "span_to")


def shared_spans(records: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """field, id, span_from, span_to over a whole table, added to an empty index in batches split by hash of the id."""
    index = SpanIndex(records.sparkSession, length, gram)
    shared = None
    for i in range(batches):
        more = index.add(records.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
        shared = more if shared is None else shared.unionAll(more)
    out = index.verify(records, shared)
    index.drop()  # nothing of the result reads the runs any more
    return out


def coverage(records: DataFrame, spans: DataFrame) -> DataFrame:
    """field, id, shared_chars, chars, share for every record with text; 0 where nothing is shared."""
    got = spans.groupBy("field", "id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared_chars"))
    base = records.filter("text is not null and id is not null").groupBy("field", "id").agg(F.max(F.length("text")).alias("chars"))
    out = base.join(got, ["field", "id"], "left").na.fill(0, ["shared_chars"])
    return out.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))
