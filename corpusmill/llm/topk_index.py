"""Exact top-k inner products over a pivot-distance index.

Vectors are quantised to integers.  With M the greatest norm, each data vector v gets one more
coordinate sqrt(M^2 - |v|^2) and each query a zero; then q . v = (|q|^2 + M^2 - d^2) / 2 with d
the distance between the two, so the highest scores are the nearest vectors.

Vectors whose squared norm after scaling is 2^62 or more are refused: products might not fit in 64 bits.

Every vector is keyed by its nearest pivot and its distance to it.  Pivots come from a bounded,
documented sample (``sample`` rows, farthest first); every vector is indexed.  Distances are cut
into ``RINGS`` rings a pivot; rings are joined into annuli of at least ``block_rows`` vectors,
and an annulus with more is split by a hash of the id.  The catalogue of annuli (at most pivots
x rings entries, whatever the data) is all that the driver holds.

A query first searches the block it falls in, which gives a lower bound on its k-th score.  It
then expands over the annuli whose triangle-inequality bound, the greatest | d(q,p) - d(v,p) | over all
pivots p, lets a score as good as its k-th be there, and stops at the others.  Blocks meet only the
queries that need them, in slices of bounded size.

Defined results: vectors that are null or hold a null, NaN or infinity take no part; shorter
vectors count as padded with zeros; ties go to the smaller id; a repeated row is a candidate each
time it stands, but an id is one query (its least vector); a query's own id is never its answer;
fewer than k candidates give fewer rows; null ids take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

RINGS = 128
SLICE = 8192
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column, dim: int):
    """An Arrow list column as a matrix of 64-bit integers, padded with zeros."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def products(a, b, exact_in_double: bool):
    """Integer inner products of all rows, by floating point where that is exact."""
    import numpy as np

    if exact_in_double:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def farthest_first(points, k: int):
    """Up to ``k`` of the points, each as far from the earlier ones as can be."""
    import numpy as np

    chosen, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


@dataclass
class Catalogue:
    """Pivots and annuli of an index: for each annulus its pivot, its least and greatest distance to every pivot, and its number of blocks."""

    pivots: object
    greatest: float
    width: float
    annulus_of: dict[tuple[int, int], int]
    pivot: list[int]
    near: object
    far: object
    parts: list[int]

    def lifted(self, v):
        """The extra coordinate of data vectors."""
        import numpy as np

        return np.sqrt(np.maximum(self.greatest**2 - (v**2).sum(axis=1), 0))

    def pivot_distances(self, v, last):
        """Distances of vectors (with last coordinate ``last``) to every pivot."""
        import numpy as np

        p, e = self.pivots, self.lifted(self.pivots)
        squares = (v**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * (v @ p.T) + (last[:, None] - e) ** 2
        return np.sqrt(np.maximum(squares, 0))

    def best_scores(self, q):
        """For each query and annulus, a bound no score there exceeds."""
        import numpy as np

        d = self.pivot_distances(q, np.zeros(len(q)))
        # a vector's own pivot is its nearest one: half the gap to the query's nearest pivot lies between
        low = np.maximum((d[:, self.pivot] - d.min(axis=1)[:, None]) / 2, 0)
        for p in range(d.shape[1]):
            own = d[:, p, None]
            low = np.maximum(low, np.maximum(own - self.far[:, p], self.near[:, p] - own))
        low = np.maximum(low - 1e-6 * (self.greatest + 1), 0)
        return ((q**2).sum(axis=1)[:, None] + self.greatest**2 - low**2) / 2 + 1e-6 * self.greatest**2


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, *, pivots: int = 32, sample: int = 2048, block_rows: int = 2048, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of every query row of ``vectors`` (vec_id, embedding).

    ``seen`` gets ``visited``: the share of all pairs of a query and a vector that are compared.
    """
    import numpy as np

    spark = vectors.sparkSession
    data = quantised(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, dim, most, queries_n = data.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.count(F.when(is_query, 1))).first()
    if not count or not queries_n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if most >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit in 64 bits")
    dim, exact = max(dim, 1), most < 2.0**52
    picked = [r[0] for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    points = np.zeros((len(picked), dim))
    for i, v in enumerate(picked):
        points[i, : len(v)] = v
    greatest = float(np.sqrt(most)) + 1.0
    catalogue = Catalogue(farthest_first(points, pivots), greatest, 2.01 * greatest / RINGS, {}, [], None, None, [])
    rings = spark.sparkContext.broadcast(catalogue)

    def key(batches):
        import pyarrow as pa

        c = rings.value
        for batch in batches:
            v = matrix(batch.column(1), dim).astype(np.float64)
            d = c.pivot_distances(v, c.lifted(v))
            nearest = d.argmin(axis=1)
            own = d[np.arange(len(v)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array((own / c.width).astype(np.int32))], names=["vec_id", "v", "pivot", "ring"])

    keyed = cut(data.mapInArrow(key, "vec_id long, v array<long>, pivot int, ring int"))
    open_annulus: dict[int, int] = {}
    held: list[int] = []
    for pivot, ring, n in sorted(tuple(r) for r in keyed.groupBy("pivot", "ring").agg(F.count("*")).collect()):
        a = open_annulus.get(pivot)
        if a is None or held[a] >= block_rows:
            a = open_annulus[pivot] = len(held)
            held.append(0)
            catalogue.pivot.append(pivot)
        held[a] += n
        catalogue.annulus_of[pivot, ring] = a
    catalogue.parts = [max(1, -(-n // (2 * block_rows))) for n in held]
    cells = spark.createDataFrame([(p, r, a, catalogue.parts[a]) for (p, r), a in catalogue.annulus_of.items()], "pivot int, ring int, annulus int, parts int")
    indexed = keyed.join(F.broadcast(cells), ["pivot", "ring"]).select("vec_id", "v", "annulus", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))

    def spread(batches):
        """The least and greatest distance to every pivot of the vectors of an annulus in a batch."""
        import pyarrow as pa

        c = rings.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dim).astype(np.float64)
                own = batch.column(0).to_numpy()
                order = np.argsort(own, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
                d = c.pivot_distances(v, c.lifted(v))[order]
                near, far = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
                columns = np.repeat(own[order][starts], d.shape[1]), np.tile(np.arange(d.shape[1], dtype=np.int32), len(starts)), near.ravel(), far.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["annulus", "p", "near", "far"])

    spans = indexed.select("annulus", "v").mapInArrow(spread, "annulus int, p int, near double, far double").groupBy("annulus", "p").agg(F.min("near").alias("near"), F.max("far").alias("far")).toArrow()
    catalogue.near, catalogue.far = np.zeros((2, len(held), len(catalogue.pivots)))
    at = spans.column("annulus").to_numpy(), spans.column("p").to_numpy()
    catalogue.near[at], catalogue.far[at] = spans.column("near").to_numpy(), spans.column("far").to_numpy()
    slices = -(-queries_n // SLICE)
    queries = indexed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "annulus", "part")).alias("x")).select("query_id", F.col("x.v").alias("q"), F.col("x.annulus").alias("annulus"), F.col("x.part").alias("part"))
    sent = spark.sparkContext.broadcast(catalogue)

    def best(block, wanted, keep: int):
        """Rows (query number, vec_id, score) of the best of a block for each query."""
        ids, v = block.column("vec_id").to_numpy(), matrix(block.column("v").combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        q, own = matrix(wanted.column("q").combine_chunks(), dim), wanted.column("query_id").to_numpy()
        least = wanted.column("least").to_numpy(zero_copy_only=False)
        for a in range(0, len(q), 1024):
            scores = products(q[a : a + 1024], v, exact)
            scores[own[a : a + 1024, None] == ids[None, :]] = np.iinfo(np.int64).min
            for i, row in enumerate(scores):
                top = np.argsort(-row, kind="stable")[:keep] if len(row) <= keep else np.flatnonzero(row >= np.partition(row, len(row) - keep)[len(row) - keep])
                top = top[(row[top] > np.iinfo(np.int64).min) & (row[top] >= least[a + i])]
                top = top[np.lexsort((ids[top], -row[top]))][:keep]
                yield a + i, ids[top], row[top]

    def first_bound(block, wanted):
        import pyarrow as pa

        if not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.list_(pa.int64())), "least": pa.array([], pa.float64())})
        out = np.full(wanted.num_rows, -np.inf)
        if block.num_rows:
            for i, _, scores in best(block, wanted.append_column("least", pa.array(out)), k):
                if len(scores) == k:
                    out[i] = scores[-1]
        return wanted.select(["query_id", "q"]).append_column("least", pa.array(out))

    def dealt(wanted: DataFrame) -> DataFrame:
        """The vectors of each block once for each slice of queries that asks for it; blocks that nobody asks for are left out."""
        asked = wanted.select(*[F.col(c).alias(c) for c in keys]).distinct()
        return indexed.join(asked, ["annulus", "part"])

    keys = ["annulus", "part", "slice"]
    home = queries.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
    bounded = cut(dealt(home).groupBy(*keys).cogroup(home.groupBy(*keys)).applyInArrow(first_bound, "query_id long, q array<long>, least double"))

    def expand(batches):
        """Every query once for each block that it must search."""
        import pyarrow as pa

        c = sent.value
        parts = np.array(c.parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                scores = c.best_scores(matrix(piece.column(1), dim).astype(np.float64))
                rows, annuli = np.nonzero(scores >= piece.column(2).to_numpy()[:, None])
                times = parts[annuli]
                part = np.concatenate([np.arange(n) for n in times]) if len(times) else np.zeros(0)
                rows, annuli = np.repeat(rows, times), np.repeat(annuli, times)
                for b in range(0, len(rows), 8192):
                    some = piece.take(pa.array(rows[b : b + 8192]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(annuli[b : b + 8192].astype(np.int32)), pa.array(part[b : b + 8192].astype(np.int32))], names=["query_id", "q", "least", "annulus", "part"])

    needed = bounded.mapInArrow(expand, "query_id long, q array<long>, least double, annulus int, part int").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))

    def search(block, wanted):
        import pyarrow as pa

        found = list(best(block, wanted, k)) if block.num_rows and wanted.num_rows else []
        own = wanted.column("query_id").to_numpy() if found else np.zeros(0, np.int64)
        some = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": np.repeat(own[[f[0] for f in found]] if found else own, [len(f[1]) for f in found]), "vec_id": some(1), "score": some(2)})

    if seen is not None:
        sizes = indexed.groupBy("annulus", "part").agg(F.count("*").alias("n"))
        pairs = needed.join(sizes, ["annulus", "part"]).agg(F.sum("n")).first()[0] or 0
        seen["visited"] = pairs / (count * queries.count())
    found = dealt(needed).groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInArrow(search, RESULT)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
