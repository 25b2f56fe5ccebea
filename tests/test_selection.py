"""Pairs of a large selection: against plain sums, over several tiles and multiplications, and within a bounded time."""

import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chandas.operators import compare, similarity

from .fixtures import VERSES

KINDS = ["phoneme", "swara"]


def plain(x: dict, y: dict) -> list[float]:
    shared = x.keys() & y.keys()
    dot, active = float(sum(x[k] * y[k] for k in shared)), len(x.keys() | y.keys())
    ma, mb = (math.sqrt(sum(v * v for v in z.values())) for z in (x, y))
    ta, tb = sum(x.values()), sum(y.values())
    conf = (len(shared) / active + min(ta, tb) / max(ta, tb) + min(1, active / 8)) / 3 if ta and tb else 0.0
    return [dot, ma, mb, dot / (ma * mb) if ma and mb else 0.0, conf]


def owners(n: int) -> dict[int, dict[str, dict[str, int]]]:
    """Some without one kind or both, two with many keys."""
    rnd = random.Random(3)
    out = {i * 7 - 20: {k: {f"k{rnd.randrange(12)}": rnd.randint(1, 9) for _ in range(rnd.randrange(8))} for k in KINDS} for i in range(n)}
    for i in (8, 36):
        out[i]["phoneme"] = {f"k{j}": 1 + j % (i + 1) for j in range(100)}
    return out


def check(rows, data):
    got = {(r["owner_a"], r["owner_b"]): r for r in rows}
    assert len(got) == len(rows)
    for (a, b), r in got.items():
        assert (r["twice_a"], r["twice_b"]) == (a * 2, b * 2)
        for k in KINDS:
            assert [r[f"{k}_{n}"] for n in similarity.SCORES] == pytest.approx(plain(data[a][k], data[b][k])), (a, b, k)
    return set(got)


def test_tiles_and_multiplications(monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 4)
    monkeypatch.setattr(similarity, "KEYS", 5)
    data = owners(21)
    for blocks in (1, 2):
        cols = {"owner": list(data), "twice": [o * 2 for o in data], "_block": [i % blocks for i in range(len(data))], "_low": [0] * len(data), "_high": [blocks - 1] * len(data)}
        for k in KINDS:
            cols |= {f"{k}_keys": [list(d[k]) for d in data.values()], f"{k}_values": [[float(v) for v in d[k].values()] for d in data.values()]}
            cols |= {f"{k}_total": [float(sum(d[k].values())) for d in data.values()], f"{k}_squares": [float(sum(v * v for v in d[k].values())) for d in data.values()]}
        for k in KINDS:
            cols[f"{k}_keys"] = pa.array(cols[f"{k}_keys"], pa.list_(pa.string()))
            cols[f"{k}_values"] = pa.array(cols[f"{k}_values"], pa.list_(pa.float64()))
        t = pa.table(cols)
        rows = [r for b in similarity._block_pairs("owner", KINDS, ["twice"], None)(iter(t.to_batches(max_chunksize=6))) for r in b.to_pylist()]
        block = dict(zip(cols["owner"], cols["_block"]))
        assert check(rows, data) == {(a, b) for a in data for b in data if a < b and (blocks == 1 or block[a] != block[b])}


def test_selection_pairs(spark):
    data = owners(90)
    f = [(o, o * 2, k, key, v) for o, d in data.items() for k in KINDS for key, v in d[k].items()] + [(o, o * 2, "none", "", 1) for o in data]
    p = similarity.profile(spark.createDataFrame(f + [(None, 0, "none", "", 1)], "owner int, twice long, kind string, key string, value long"), ["owner", "twice"])
    rows = similarity.selection_pairs(p, "owner", KINDS, ["twice"]).collect()
    assert check(rows, data) == {(a, b) for a in data for b in data if a < b}
    one = similarity.selection_pairs(p.filter("owner = 8"), "owner", KINDS, ["twice"])
    assert one.count() == 0 and one.columns == similarity.pairs(p.withColumn("all", F.lit(0)), ["all"], "owner", KINDS, ["twice"]).drop("all").columns


def test_rounding():
    x = similarity.np.array([0.0078125, 0.9352884999, 1163.0, 0.0])
    assert similarity._round(x, 6).tolist() == [0.007813, 0.935288, 1163.0, 0.0] and similarity._round(x, None) is x


def test_many_hymns_in_time(spark):
    """A join on one constant key with maps searched for each pair took more than six minutes for as many."""
    n, lines = 1200, [v[2] for v in VERSES]
    v = spark.createDataFrame([(h, h % len(lines) if h else None) for h in range(n)], "hymn_index int, k int")
    v = v.withColumn("verse_ord", F.explode(F.array(*map(F.lit, range(3)))))
    text = F.array(*map(F.lit, lines))
    v = v.withColumn("dev", F.concat_ws(" ", *[F.try_element_at(text, ((F.col("k") + F.col("verse_ord") + i) % len(lines) + 1).cast("int")) for i in range(4)]))
    began = time.time()
    got = compare.compare_hymns(v).agg(F.count(F.lit(1)), F.sum((F.col("hymn_index_a") < F.col("hymn_index_b")).cast("int")), F.min("verses_a"), F.max("meter_cosine_similarity"), F.min("phoneme_confidence")).first()
    assert time.time() - began < 120
    pairs = n * (n - 1) // 2
    assert got[:3] == (pairs, pairs, 3) and got[3] == pytest.approx(1) and got[4] == 0
