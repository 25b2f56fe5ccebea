"""Nearest vectors by cosine with randomly rotated one-bit codes.

Unit vectors are taken relative to the nearest of some centroids, padded, turned by one random rotation, and kept as
the sign bits of the result, packed, with two scalars: the residual's length and its inner product with its own code.
From a query's rotated residual and the bits follows an unbiased estimate of the inner product, and from the scalars a
bound on its error. Only vectors whose upper bound reaches a query's k-th best exact cosine so far are reranked exactly.

The index is a table of packed blocks (one row holds up to BLOCK vectors of one cluster), written once. Queries are
packed alike, by cluster, and joined with the blocks, so neither side passes through the driver. A first round searches
each query's own cluster and gives it a k-th best cosine; a second goes to those other clusters only whose nearest
possible vector (by the angle to the centroid and the cluster's widest angle, which is no estimate) could still reach it.
A cluster of many blocks is cut by a salt into shares of SHARE blocks, and its queries are copied to each share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chandas.common import cut, shuffle_partitions

#: Rows the centroids are fitted on, at most and for each; clusters are as many as blocks could be filled, within limits.
FIT_ROWS, FIT_EACH, FIT_STEPS, LEAST_CENTROIDS, MOST_CENTROIDS = 16_384, 64, 8, 8, 1024
#: Vectors of a packed block, of index and of queries; blocks of a cluster that one task searches.
BLOCK, SHARE = 4096, 64
#: Multiple of the error's standard deviation; 4 leaves out a true neighbour about once in 30,000. None: no estimate, exact.
EPSILON = 4.0
MIN_BITS = 128
SEED = 20240501
#: Queries whose best neighbours a task holds at a time.
HELD_QUERIES = 200_000

INDEX = "cluster int, n int, radius double, ids binary, codes binary, scalars binary, vectors binary"
PACKED = "cluster int, salt int, qids binary, qvecs binary, qleast binary"
FOUND = "query_id long, neighbor_id long, cosine double"


def _unit(m):
    import numpy as np

    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def _bits(dim: int) -> int:
    return max(MIN_BITS, -(-dim // 64) * 64)


def _rotation(dim: int):
    """The first `dim` columns of a random orthogonal matrix: the others only ever meet the padding's zeros."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((_bits(dim), _bits(dim))))
    return (q * np.sign(np.diag(r)))[:, :dim].astype(np.float32)


def fit(vectors: DataFrame, rows: int):
    """Centroids of a bounded sample, by hash of the id: at most FIT_ROWS rows come to the driver. rows: how many there are."""
    import numpy as np

    many = min(MOST_CENTROIDS, max(LEAST_CENTROIDS, rows // BLOCK))
    some = vectors.filter("id is not null and vec is not null").orderBy(F.xxhash64("id"), "id").select("vec")
    got = some.limit(min(FIT_ROWS, many * FIT_EACH)).toPandas()["vec"]
    if not len(got):
        return np.zeros((1, 1))
    m, norm = _unit(np.array([np.asarray(v, float) for v in got]))
    m = m[norm > 0]
    if not len(m):
        return np.zeros((1, len(got.iloc[0])))
    rng = np.random.default_rng(SEED)
    c = m[rng.choice(len(m), min(len(m), many), replace=False)]
    for _ in range(FIT_STEPS):
        near = np.argmax(m @ c.T - (c * c).sum(1) / 2, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        size = np.bincount(near, minlength=len(c))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _nearest_centroid(unit, centroids):
    import numpy as np

    return np.argmax(unit @ centroids.T - (centroids * centroids).sum(1) / 2, 1)


def _angles(unit, centroids):
    """Angle of each vector to each centroid; of one without direction pi / 2, which a radius of pi makes no limit."""
    import numpy as np

    c, _ = _unit(centroids)
    return np.arccos(np.clip(unit @ c.T, -1, 1))


def build_index(vectors: DataFrame, centroids) -> DataFrame:
    """Packed blocks of all vectors (id long, vec array<double>). Null ids, null or zero vectors have no cosine: left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        dim = centroids.shape[1]
        turn, d = _rotation(dim), _bits(dim)
        held: dict[int, list] = {}

        def pack(c: int):
            ids, codes, scalars, vecs = (np.concatenate(x) for x in zip(*held.pop(c)))
            direction = (centroids[c] ** 2).sum() > 0
            radius = float(_angles(_unit(vecs)[0], centroids[c : c + 1]).max()) if direction else np.pi
            return c, len(ids), radius, ids.tobytes(), codes.tobytes(), scalars.tobytes(), vecs.tobytes()

        def out(rows):
            types = (pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["cluster", "n", "radius", "ids", "codes", "scalars", "vectors"])

        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            ids = t["id"].to_numpy()
            vec = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), dim)
            unit, norm = _unit(np.nan_to_num(vec))
            ok = norm > 0
            ids, vec, unit = ids[ok], vec[ok], unit[ok]
            near = _nearest_centroid(unit, centroids)
            rest = unit - centroids[near]
            size = np.sqrt((rest * rest).sum(1))
            turned = (rest / np.where(size > 0, size, 1)[:, None]).astype(np.float32) @ turn.T
            codes = np.packbits(turned > 0, axis=1)
            own = np.abs(turned).sum(1) / np.sqrt(d)
            shift = (unit * centroids[near]).sum(1) - (centroids[near] ** 2).sum(1)
            scalars = np.stack([size, np.where(own > 0, own, 1), shift], 1).astype(np.float32)
            for c in np.unique(near):
                m = near == c
                held.setdefault(int(c), []).append((ids[m], codes[m], scalars[m], vec[m]))
            full = [c for c, parts in held.items() if sum(len(p[0]) for p in parts) >= BLOCK]
            if full:
                yield out([pack(c) for c in full])
        for c in list(held):
            yield out([pack(c)])

    return _clean(vectors).mapInArrow(run, INDEX)


def _clean(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter("id is not null and vec is not null")


def _pack_with(centroids, clusters: dict[int, tuple[float, int]], home: bool):
    """Queries (id, vec, least: the cosine a neighbour must reach) packed by cluster: each in its own, or in all others it must visit.

    clusters: of each cluster that has vectors its widest angle and its number of shares.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        dim = centroids.shape[1]
        numbers = np.array(sorted(clusters))
        radius = np.array([clusters[c][0] for c in numbers])
        held: dict[int, list] = {}

        def rows(c: int):
            ids, vecs, least = (np.concatenate(x) for x in zip(*held.pop(c)))
            return [(c, salt, ids.tobytes(), vecs.tobytes(), least.tobytes()) for salt in range(clusters[c][1])]

        def out(got):
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate(types)], names=["cluster", "salt", "qids", "qvecs", "qleast"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids, least = t["id"].to_numpy(), t["least"].to_numpy()
            vec = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), dim)
            unit, norm = _unit(np.nan_to_num(vec))
            near = _nearest_centroid(unit, centroids)
            # the closest that any vector of a cluster can be
            reach = np.cos(np.maximum(0, _angles(unit, centroids[numbers]) - radius)) + 1e-9
            go = (near[:, None] == numbers) if home else ((near[:, None] != numbers) & (reach >= least[:, None]))
            go &= norm[:, None] > 0
            for j in np.flatnonzero(go.any(0)):
                m = go[:, j]
                held.setdefault(int(numbers[j]), []).append((ids[m], vec[m], least[m]))
            full = [c for c, parts in held.items() if sum(len(p[0]) for p in parts) >= BLOCK]
            for c in full:
                yield out(rows(c))
        for c in list(held):
            yield out(rows(c))

    return run


class _Best:
    """The k best neighbours so far of a block of queries, from exact cosines."""

    def __init__(self, ids, vecs, least, k: int):
        import numpy as np

        self.ids, self.k, self.least = ids, k, least
        self.unit, _ = _unit(vecs)
        self.cos, self.near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def bar(self):
        """The cosine a further neighbour must reach."""
        import numpy as np

        return np.maximum(self.cos[:, -1], self.least)

    def offer(self, q, cos, ids) -> None:
        """Exact cosines of (query row, id); the k best by cosine, then smaller id, are kept."""
        import numpy as np

        k = self.k
        rows, at = np.unique(q, return_inverse=True)
        aq = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
        ac = np.concatenate([self.cos[rows].ravel(), cos])
        ai = np.concatenate([self.near[rows].ravel(), ids])
        order = np.lexsort((ai, -ac, aq))
        aq, ac, ai = aq[order], ac[order], ai[order]
        same = np.zeros(len(aq), bool)  # one id may come in several rows
        same[1:] = (aq[1:] == aq[:-1]) & (ai[1:] == ai[:-1]) & (ac[1:] == ac[:-1]) & np.isfinite(ac[1:])
        aq, ac, ai = aq[~same], ac[~same], ai[~same]
        rank = np.arange(len(aq)) - np.searchsorted(aq, aq)
        keep = rank < k
        c, i = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
        c[aq[keep], rank[keep]], i[aq[keep], rank[keep]] = ac[keep], ai[keep]
        self.cos[rows], self.near[rows] = c, i

    def batch(self):
        import numpy as np
        import pyarrow as pa

        q, r = np.nonzero(np.isfinite(self.cos))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.near[q, r]), pa.array(self.cos[q, r])], names=["query_id", "neighbor_id", "cosine"])


class _Block:
    """A packed block of the index, opened."""

    def __init__(self, centroid, turn, n, radius, ids, codes, scalars, vecs):
        import numpy as np

        d, dim = turn.shape
        self.center, self.turn, self.radius = centroid, turn, radius
        self.ids, self.unit = np.frombuffer(ids, np.int64), _unit(np.frombuffer(vecs, np.float64).reshape(n, dim))[0]
        scalars = np.frombuffer(scalars, np.float32).reshape(n, 3)
        # +-1 codes from the packed bits; their inner product with a rotated query is the estimate's core
        self.signs = np.unpackbits(np.frombuffer(codes, np.uint8).reshape(n, d // 8), axis=1, count=d).astype(np.float32) * np.float32(2) - np.float32(1)
        own = scalars[:, 1]
        self.scale = scalars[:, 0] / (own * np.float32(np.sqrt(d)))
        self.slack = scalars[:, 0] * np.sqrt(np.maximum(0, 1 - own * own)) / own / np.float32(np.sqrt(d - 1))
        self.shift = scalars[:, 2]

    def candidates(self, best: _Best, rows, epsilon: float | None):
        """(query row, place) pairs of some queries whose cosine may reach the query's bar."""
        import numpy as np

        if epsilon is None:
            return (x.ravel() for x in np.meshgrid(rows, np.arange(len(self.ids)), indexing="ij"))
        unit = best.unit[rows]
        rest = unit - self.center
        size = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.where(size > 0, size, 1)[:, None]).astype(np.float32) @ self.turn.T
        upper = turned @ self.signs.T
        upper *= self.scale
        upper += self.slack * np.float32(epsilon)
        upper *= size[:, None].astype(np.float32)
        upper += (unit @ self.center).astype(np.float32)[:, None] + self.shift
        q, o = np.nonzero(upper >= (best.bar()[rows, None] - 2e-6).astype(np.float32))
        return rows[q], o

    def search(self, best: _Best, epsilon: float | None, rows: int = 512, pairs: int = 1 << 18) -> None:
        import numpy as np

        # queries that no vector of the block, at the widest angle in it, could satisfy are left out
        reach = np.cos(np.maximum(0, _angles(best.unit, self.center[None])[:, 0] - self.radius)) + 1e-9
        asked = np.flatnonzero(reach >= best.bar())
        for a in range(0, len(asked), rows):
            q, o = self.candidates(best, asked[a : a + rows], epsilon)
            for p in range(0, len(q), pairs):
                qq, oo = q[p : p + pairs], o[p : p + pairs]
                cos = np.round(np.einsum("ij,ij->i", best.unit[qq], self.unit[oo]), 9)
                ok = (self.ids[oo] != best.ids[qq]) & (cos > 0) & (cos >= best.bar()[qq])
                if ok.any():
                    best.offer(qq[ok], cos[ok], self.ids[oo][ok])


def _search_with(centroids, k: int, epsilon: float | None):
    def run(batches):
        import numpy as np

        turn = _rotation(centroids.shape[1])
        held: dict[bytes, _Best] = {}
        last, block, n = None, None, 0
        for b in batches:
            for cluster, rows, radius, ids, codes, scalars, vecs, qids, qvecs, qleast in zip(*(b.column(j).to_pylist() for j in range(10))):
                if ids != last:
                    last, block = ids, _Block(centroids[cluster], turn, rows, radius, ids, codes, scalars, vecs)
                best = held.get(qids)
                if best is None:
                    if n >= HELD_QUERIES:  # what was found so far is put out; the k best are taken among all that is
                        for x in held.values():
                            yield x.batch()
                        held, n = {}, 0
                    q = np.frombuffer(qids, np.int64)
                    best = held[qids] = _Best(q, np.frombuffer(qvecs, np.float64).reshape(len(q), -1), np.frombuffer(qleast, np.float64), k)
                    n += len(q)
                block.search(best, epsilon)
        for x in held.values():
            yield x.batch()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank: one shuffle by query."""
    order = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "neighbor_id")
    once = found.repartition(shuffle_partitions(found.sparkSession), "query_id").dropDuplicates(["query_id", "neighbor_id", "cosine"])
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, centroids, k: int, epsilon: float | None = EPSILON) -> DataFrame:
    """query_id, neighbor_id, cosine (9 decimals), rank: the k other vectors of greatest cosine above 0, ties to smaller ids.

    index: as build_index gives it, written or checkpointed, since it is read three times.
    """
    # at most MOST_CENTROIDS rows
    stats = index.groupBy("cluster").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("blocks")).collect()
    clusters = {r["cluster"]: (r["radius"], -(-r["blocks"] // SHARE)) for r in stats}
    if not clusters:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    shares = F.element_at(F.create_map(*[F.lit(x) for c, (_, n) in clusters.items() for x in (c, n)]), F.col("cluster"))
    salted = index.withColumn("salt", F.pmod(F.xxhash64("ids"), shares).cast("int"))
    parts = shuffle_partitions(index.sparkSession)

    def visited(q: DataFrame, home: bool) -> DataFrame:
        packed = q.mapInArrow(_pack_with(centroids, clusters, home), PACKED).repartition(parts, "cluster", "salt").alias("q")
        both = salted.repartition(parts, "cluster", "salt").alias("i").join(packed, ["cluster", "salt"])
        return both.select("cluster", "n", "radius", "ids", "codes", "scalars", "vectors", "qids", "qvecs", "qleast").mapInArrow(_search_with(centroids, k, epsilon), FOUND)

    asked = _clean(queries)
    first = cut(_ranked(visited(asked.withColumn("least", F.lit(0.0)), True), k))
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("cosine").alias("least"))
    again = asked.join(least, "id", "left").select("id", "vec", F.coalesce("least", F.lit(0.0)).alias("least"))
    return _ranked(first.drop("rank").unionAll(visited(again, False)), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, epsilon: float | None = EPSILON) -> DataFrame:
    """Fit, index every row of `vectors` (id, vec; one row an id), and search it for `queries` (same columns).

    Null ids, null and zero vectors have no cosine and are left out. epsilon: see EPSILON; with None the result is exact.
    """
    v = _clean(vectors)
    centroids = fit(v, v.count())
    return search(cut(build_index(v, centroids)), queries, centroids, k, epsilon)
