"""Counts of every n-gram up to a length, and of the records holding it, by sorted suffixes.

Every position of a record's term sequence gives the suffix that starts there, cut to `sigma` terms. Before anything is
shuffled, equal suffixes of a task's records are put together: one row with their number and the sorted ids of their
records. Rows go to the partition of their first term, are sorted in reverse lexicographic order, and one pass with a
stack sums the counts and record sets of all prefixes: when the next suffix no longer shares a prefix, that prefix is
complete, is put out, and is merged into the next shorter one.

A term that every record holds would make record sets as large as the collection. Records are therefore split by hash
into sets of about SPLIT_RECORDS, a first term's rows are routed for each split apart, and since the splits' record sets
are disjoint, their record counts simply add up. Memory is bounded by SPLIT_RECORDS, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chandas.common import shuffle_partitions

#: Records whose ids may come together in one task, and positions put together at a time before the shuffle.
SPLIT_RECORDS, CHUNK = 1 << 20, 500_000
OUT = T.StructType([T.StructField("term_set", T.StringType()), T.StructField("ngram", T.ArrayType(T.StringType())), T.StructField("cf", T.LongType()), T.StructField("df", T.LongType())])
SUFFIXES = T.StructType([
    T.StructField("term_set", T.StringType()), T.StructField("split", T.IntegerType()), T.StructField("suffix", T.ArrayType(T.StringType())),
    T.StructField("records", T.BinaryType()), T.StructField("cf", T.LongType()),
])


def stack_counts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(group, suffix, record ids, weight) in reverse lexicographic order within a group -> (group, prefix, weight, records).

    Record ids are arrays; of each prefix on the stack the arrays met so far are kept and united when it is complete.
    """
    import numpy as np

    stack: list[list] = []  # [term, weight, arrays of record ids]
    group = None

    def unwind(to: int):
        while len(stack) > to:
            _, weight, arrays = stack[-1]
            ids = np.unique(np.concatenate(arrays)) if len(arrays) > 1 else arrays[0]
            yield group, [s[0] for s in stack], weight, len(ids)
            stack.pop()
            if stack:
                stack[-1][1] += weight
                stack[-1][2].append(ids)

    for g, suffix, ids, weight in rows:
        if g != group:
            yield from unwind(0)
            group = g
        same = 0
        while same < len(stack) and same < len(suffix) and stack[same][0] == suffix[same]:
            same += 1
        yield from unwind(same)
        for term in suffix[same:]:
            stack.append([term, 0, []])
        if stack:
            stack[-1][1] += weight
            stack[-1][2].append(ids)
    yield from unwind(0)


def _put_together(sets, records, terms, weights, sigma: int, splits: int):
    """One Arrow batch of distinct suffixes, their record ids (differences of sorted ids) and summed weights."""
    import numpy as np
    import pyarrow as pa

    lengths = np.diff(terms.offsets.to_numpy())
    row = np.repeat(np.arange(len(terms)), lengths)
    flat, weight = terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False)
    ok = flat.is_valid().to_numpy(zero_copy_only=False)
    flat, row, weight = flat.filter(pa.array(ok)).dictionary_encode(), row[ok], weight[ok]
    names = sets.dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    ids = records.to_numpy()[row]
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    split = ((mixed >> np.uint64(33)) % np.uint64(splits)).astype(np.int64)
    key = names.indices.to_numpy().astype(np.int64)[row] * splits + split
    size = len(flat.dictionary) + 1
    columns = []
    for j in range(sigma):
        c = np.full(len(codes), -1, np.int64)
        if j < len(codes):
            c[: len(codes) - j] = np.where(row[j:] == row[: len(row) - j], codes[j:], -1)
        columns.append(c)
        key = np.unique(key * size + c + 1, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((ids, key))
    key, ids, weight = key[order], ids[order], weight[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cf = np.add.reduceat(weight, start) if len(start) else weight
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    step = np.diff(ids, prepend=0)
    step[start] = ids[start]
    group = np.cumsum(np.isin(np.arange(len(key)), start, assume_unique=True)) - 1
    kept, held = step[fresh], np.bincount(group[fresh], minlength=len(start))
    at = order[start]
    ends = np.concatenate([[0], np.cumsum(held * 8)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.astype(np.int64).tobytes())])
    shape = np.stack([c[at] for c in columns], 1) if len(at) else np.zeros((0, sigma), np.int64)
    long = (shape >= 0).sum(1)
    spelled = flat.dictionary.take(pa.array(shape[shape >= 0]))
    suffix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32)), spelled)
    where = names.dictionary.take(pa.array(np.asarray(names.indices)[row[at]]))
    return pa.RecordBatch.from_arrays([where, pa.array(split[at].astype(np.int32)), suffix, binary, pa.array(cf.astype(np.int64))], names=["term_set", "split", "suffix", "records", "cf"])


def _suffixes(sigma: int, splits: int, chunk: int):
    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def flush():
            t = pa.Table.from_batches(held)
            return _put_together(*(t.column(i).combine_chunks() for i in range(4)), sigma, splits)

        for b in batches:
            # a record of many terms makes a batch of its own size; batches of short ones are put together
            held.append(b)
            n += len(b.column(2).flatten())
            if n >= chunk:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _reduce(batches):
    import numpy as np
    import pyarrow as pa

    def rows():
        for b in batches:
            s, k, x, r, w = (b.column(i).to_pylist() for i in range(5))
            for a, split, suffix, ids, cf in zip(s, k, x, r, w):
                yield (a, split), suffix, np.cumsum(np.frombuffer(ids, np.int64)), cf

    out: tuple[list, ...] = ([], [], [], [])
    schema = pa.schema([("term_set", pa.string()), ("ngram", pa.list_(pa.string())), ("cf", pa.int64()), ("df", pa.int64())])
    for (s, _), gram, cf, df in stack_counts(rows()):
        for col, v in zip(out, (s, gram, cf, df)):
            col.append(v)
        if len(out[0]) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            out = ([], [], [], [])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def ngram_counts(records: DataFrame, sigma: int, most_records: int | None = None) -> DataFrame:
    """term_set, ngram, cf (occurrences), df (records) of all n-grams of 1..sigma terms.

    records: term_set string, record long, terms array<string>, weights array<long> (how often each term, and the
    suffix that starts with it, counts). Null or empty sequences, and null terms, give nothing; a record that comes in
    several rows counts once. most_records: a bound on the number of records, for the number of splits; the rows are
    counted if it isn't given. Output order is undefined.
    """
    parts = shuffle_partitions(records.sparkSession)
    splits = max(1, -(-(records.count() if most_records is None else most_records) // SPLIT_RECORDS))
    some = records.select("term_set", F.col("record").cast("long").alias("record"), "terms", F.col("weights").cast("array<bigint>").alias("weights"))
    put = some.filter("size(terms) > 0 and record is not null").mapInArrow(_suffixes(sigma, splits, CHUNK), SUFFIXES)
    routed = put.repartition(parts, "term_set", F.col("suffix")[0], "split").sortWithinPartitions("term_set", "split", F.col("suffix").desc())
    counted = routed.mapInArrow(_reduce, OUT)
    if splits == 1:  # a first term's n-grams were all counted in one place
        return counted
    return counted.groupBy("term_set", "ngram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def verdicts(counts: DataFrame, totals: DataFrame, rare_records: int = 3, common_share: float = 0.9) -> DataFrame:
    """Adds verdict: rare (at most rare_records records; checked first), common (more than common_share of all), else useful.

    totals: term_set, records; a few rows, one for each term set.
    """
    v = F.when(F.col("df") <= rare_records, "rare").when(F.col("df") > F.lit(common_share) * F.col("records"), "common").otherwise("useful")
    return counts.join(F.broadcast(totals), "term_set").withColumn("verdict", v)
