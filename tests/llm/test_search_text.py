"""Nearest vectors, look-alikes and shared spans on small inputs, with brute force and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from chandas.llm import knn, lookalike, spans


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_knn_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_CENTROIDS", 40)
    rng = np.random.default_rng(1)
    m = rng.poisson(8, (3000, 14)).astype(float)
    m[1] = m[0]  # ties
    m[7] = 0  # no direction
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = vectors(spark, rows + [(None, [1.0] * 14), (9999, None)]).repartition(5)
    found = {}
    for epsilon in (knn.EPSILON, None):
        got = found[epsilon] = {}
        for r in knn.nearest(df, df.filter("id % 100 = 0"), 5, epsilon).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.neighbor_id))
    unit = m / np.maximum(np.sqrt((m * m).sum(1)), 1e-9)[:, None]
    hit = total = 0
    for q in range(0, 3000, 100):
        c = np.round(unit @ unit[q], 9)
        c[q] = -1
        want = [int(i) for i in np.lexsort((np.arange(3000), -c))[:5]]
        hit += len(set(want) & {i for _, i in found[knn.EPSILON][q]})
        total += 5
        assert [i for _, i in sorted(found[None][q])] == want
    assert hit / total >= 0.99


def test_knn_edges(spark):
    empty = vectors(spark, [])
    assert knn.nearest(empty, empty, 3).count() == 0
    one = vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0])])
    got = [(r.query_id, r.neighbor_id) for r in knn.nearest(one, one.filter("id = 2"), 3).collect()]
    assert got == [(2, 4)]  # only cosines above 0


def test_lookalikes(spark):
    same = ["agnim", "ag​nim", "аgnim", "ａｇｎｉｍ", "agnı" + "m", "ag­nim"]
    rows = [("iast", i, x) for i, x in enumerate(same)] + [
        ("dev", 10, "अग्निः"), ("dev", 11, "अग्नि:"), ("dev", 12, "अाग"), ("dev", 13, "आग"), ("dev", 14, "रो"), ("dev", 15, "राे"),
        ("dev", 20, "अग॑"), ("dev", 21, "अग"), ("dev", 22, "अग ẓ §"), ("iast", 30, "a\u0304b"), ("iast", 31, "\u0101b"), ("iast", 40, None), ("iast", 41, ""), ("iast", 42, "ṃṁ’ ||"),
        ("iast", 43, "a\u00a0b"), ("iast", 44, "x" * 50_000 + "а"), ("iast", 0, "agnim"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "field_name string, row_id long, value string, canonical string")
    got = lookalike.canonical(df)
    assert {r.row_id for r in got.filter("odd").collect()} == {1, 2, 3, 4, 5, 11, 12, 15, 30, 43, 44}
    form = {r.row_id: r.canonical for r in got.collect()}
    assert {form[i] for i in range(6)} == {"agnim"} and form[11] == form[10] and form[12] == form[13] and form[15] == form[14] and form[30] == form[31]
    assert form[20] != form[21] and 40 not in form and form[41] == ""
    assert lookalike.canonical(df.limit(0)).count() == 0


def test_lookalikes_at_the_end(spark):
    ends = ["\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029"]
    df = spark.createDataFrame([("iast", i, "agnim" + e) for i, e in enumerate(ends)] + [("iast", 10, "agnim"), ("iast", 11, "agnim ")], "field_name string, row_id long, value string")
    got = {r.row_id: r for r in lookalike.canonical(df).collect()}
    assert {i for i, r in got.items() if r.odd and r.value != r.canonical} == set(range(len(ends)))
    assert got[0].canonical == "agnim "


def brute(rows, length):
    holders = {}
    for i, f, t in rows:
        for p in range(len(t or "") - length + 1):
            holders.setdefault((f, t[p : p + length]), set()).add(i)
    out = set()
    for i, f, t in rows:
        at = [p for p in range(len(t or "") - length + 1) if len(holders[f, t[p : p + length]]) > 1]
        while at:
            a = z = at.pop(0)
            while at and at[0] <= z + length:
                z = at.pop(0)
            out.add((f, i, a, z + length))
    return out


def test_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("अबcdé ") for _ in range(n))
    pool = [text(70) for _ in range(5)] + ["a" * 90]
    rows = []
    for i in range(300):
        rows.append((i, rnd.choice(["x", "y"]), text(rnd.randint(0, 90)) + (rnd.choice(pool)[rnd.randint(0, 9) :] if i % 3 else "") + text(rnd.randint(0, 60))))
    rows += [(900, "x", None), (901, "x", ""), (902, "y", pool[0] * 40), (903, "y", pool[0]), (903, "y", pool[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, field string, text string, start int")
    got = {tuple(r) for r in spans.shared_spans(df).select("field", "id", "span_from", "span_to").collect()}
    assert got == brute(rows, 60)
    c = {(r.field, r.id): r for r in spans.coverage(df, spans.shared_spans(df)).collect()}
    assert c["y", 903].share == 1.0 and c["x", 901].share == 0.0
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_span_index_grows_and_compacts(spark):
    rnd = random.Random(5)
    rows = [(i, "x", "".join(rnd.choice("abcdef") for _ in range(40)) + "shared passage of more than sixty code points, held by every other row" * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, field string, text string")
    index, shared = spans.SpanIndex(spark), None
    before = {t.name for t in spark.catalog.listTables() if t.name.startswith("span_run")}
    for k in range(20):
        more = index.add(df.filter(F.col("id") % 20 == k))
        shared = more if shared is None else shared.unionAll(more)
    assert [len(level) for level in index.levels] == [0, 1, 1]  # 20 batches: 16 in one run, 4 in another
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("span_run")} - before == set(index.runs)
    found = index.verify(df, shared)
    index.drop()
    assert {tuple(r) for r in found.select("field", "id", "span_from", "span_to").collect()} == brute(rows, 60)
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("span_run")} == before


def test_more_fingerprints_than_a_bit_map_holds(spark, monkeypatch):
    rnd = random.Random(7)
    pool = ["".join(rnd.choice("abc ") for _ in range(75)) for _ in range(4)]
    rows = [(i, "x", rnd.choice(pool) + "".join(rnd.choice("abc ") for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, field string, text string")
    monkeypatch.setattr(spans, "MOST_BITS", 1)
    assert {tuple(r) for r in spans.shared_spans(df).select("field", "id", "span_from", "span_to").collect()} == brute(rows, 60)


def test_compacted_query(spark, tmp_path, monkeypatch):
    from chandas.llm import queries

    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("abcdef") for _ in range(40)) + "shared passage of more than sixty code points, held by every other row" * (i % 2), None) for i in range(60)]
    spark.createDataFrame(rows, "verse_id long, dev string, iast string").write.parquet(f"{tmp_path}/verses.parquet")
    merged, plain = [], spans.SpanIndex.compact
    monkeypatch.setattr(spans.SpanIndex, "compact", lambda self, runs: (merged.append(len(runs)), plain(self, runs))[1])
    got = {tuple(r) for r in queries.QUERIES["p3_compacted"](spark, str(tmp_path)).collect()}
    assert merged == [spans.FANOUT] and got == brute([(i, "dev", d) for i, d, _ in rows], 60)


def test_confusable_letters(spark):
    letters = lookalike.confusables(spark)
    assert {letters[c] for c in "аɑａ"} == {"a"} and letters["ο"] == "o" and letters["ᾱ"] == "ā" and letters["'"] == "’" and letters["׃"] == ":"
    assert not set(letters) & set("०१ꣻᳩॽøéḵẓ†§aāḥ’|।º²")
    of = lookalike.Mapper(letters)
    assert of("र्इळे") == "ईळे" and of("अग्नि׃") == "अग्निः" and of("agnim’") == "agnim’" and of("०१ ḵø †") == "०१ ḵø †"
