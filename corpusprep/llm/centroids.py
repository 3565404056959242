"""Centroid clustering in whole numbers; a tournament of bisectors finds the nearest centroid."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage, local_frame

#: Quantised components stay below this, so that they fit in 64 bits.
_LARGEST = 2.0**62


class Bisectors:
    """Hyperplanes half way between all pairs of centroids, as integer normals and thresholds.

    x is nearer to centroid j than to i where x . 2(cj - ci) > |cj|^2 - |ci|^2. All numbers are
    whole: they are held as doubles while every sum stays below 2^53, as 64-bit integers while
    below 2^63, and else as Python integers.
    """

    def __init__(self, centroids: list[list[int]]) -> None:
        self.centroids = centroids
        self.largest = max(abs(x) for c in centroids for x in c)
        squares = [sum(x * x for x in c) for c in centroids]
        self.pairs = {
            (i, j): ([2 * (b - a) for a, b in zip(centroids[i], centroids[j])], squares[j] - squares[i])
            for j in range(len(centroids))
            for i in range(j)
        }
        self._typed: dict[type, tuple] = {}

    def _planes(self, kind: type) -> tuple:
        if kind not in self._typed:
            planes = {p: (np.array(n, kind), kind(t) if kind is not object else t) for p, (n, t) in self.pairs.items()}
            self._typed[kind] = np.array(self.centroids, kind), planes
        return self._typed[kind]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each row, the smaller number in a tie."""
        size = max(self.largest, -int(vectors.min(initial=0)), int(vectors.max(initial=0)))
        bound = 4 * vectors.shape[1] * size * size
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        points = vectors.astype(kind)
        centroids, planes = self._planes(kind)
        best = np.zeros(len(points), np.int32)
        for j in range(1, len(centroids)):
            # The one standing so far has the smaller number, so a zero keeps it.
            for i in range(j):
                rows = np.flatnonzero(best == i)
                normal, threshold = planes[i, j]
                best[rows[points[rows] @ normal > threshold]] = j
        apart = points - centroids[best]
        return best, (apart * apart).sum(axis=1)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def _quantise(dims: int, scale: int):
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dims), False))
            values = whole.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            finite = np.isfinite(values).all(axis=1)
            scaled = np.floor(values[finite] * scale)
            if len(scaled) and not np.abs(scaled).max() < _LARGEST:
                raise ValueError(f"a component times {scale} does not fit in 62 bits")
            rows = [v.tobytes() for v in scaled.astype("<i8")]
            ids = whole.column("id").filter(pa.array(finite))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.binary())], schema=schema)

    return run


def quantise(vectors: DataFrame, *, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, v``: vectors of `dims` finite components as floor(scale * x), in 64-bit little-endian integers.

    Vectors of other sizes and those with a null or not finite component are left out.
    """
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return named.mapInArrow(_quantise(dims, scale), "id bigint, v binary")


def _sums(bisectors: Bisectors, dims: int):
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(bisectors.centroids)
        totals = np.zeros((len(counts), dims), object)
        for batch in batches:
            points = _vectors(batch.column("v"), dims)
            best, _ = bisectors.nearest(points)
            # Sums of a batch stay in 64 bits where its components times its rows do.
            exact = len(points) * max(1, -int(points.min(initial=0)), int(points.max(initial=0))) < 1 << 63
            for cluster in np.unique(best):
                own = points[best == cluster]
                counts[cluster] += len(own)
                totals[cluster] += (own if exact else own.astype(object)).sum(axis=0).astype(object)
        rows = [(c, d, counts[c], int(totals[c, d])) for c in range(len(counts)) if counts[c] for d in range(dims)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return run


def _assign(bisectors: Bisectors, dims: int):
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = bisectors.nearest(_vectors(batch.column("v"), dims))
            far = pa.array([int(d) for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best), far], schema=schema)

    return run


def first_centroids(kept: DataFrame, k: int, dims: int, salt: str) -> list[list[int]]:
    """The `k` vectors with the least SHA-256 of salt and id, in that order; rows without id come last."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return [np.frombuffer(r.v, "<i8").tolist() for r in rows]


def cluster(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    scale: int = 1024,
    k: int = 8,
    rounds: int = 10,
    salt: str = "3:",
    on_round: Callable[[int, list[list[int]]], None] | None = None,
) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every vector, and the final centroids.

    Components become floor(scale * x). Each round assigns all vectors to their nearest centroid
    and moves each centroid to the floor of its vectors' mean; then they are assigned once more.
    Rounds end early when no centroid moves, which changes nothing. `on_round` is told the
    centroids after each round.

    1. Integer normals and thresholds of all pairs of centroids are computed once a round.
    2. A vector meets the centroids one by one: the sign of one product with the bisector's normal
       decides who stays, so k - 1 tests find the nearest; zero favours the smaller number. Only
       the distance to the winner is computed.
    3. A task adds up its vectors before the shuffle, so k * dims sums a task are exchanged, and
       k * dims numbers reach the driver. No cluster is ever gathered.

    All arithmetic is exact. Vectors without `dims` components and those with a null or not finite
    one are left out; so are no others. Rows that repeat an id, or have none, are vectors of
    their own. With fewer vectors than `k` there are as many centroids; without any, no row.
    Components times `scale` above 2^62, and squared distances above 2^63, raise an error.
    Other columns are not read.
    """
    kept = cut_lineage(quantise(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale))
    centroids = first_centroids(kept, k, dims, salt)
    schema = "id bigint, cluster int, distance bigint"
    if not centroids:
        return local_frame(vectors.sparkSession, [], schema), []
    for done in range(rounds):
        sums = kept.mapInArrow(_sums(Bisectors(centroids), dims), "cluster int, dim int, n bigint, total decimal(38,0)")
        moved = [list(c) for c in centroids]
        for row in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[row.cluster][row.dim] = int(row.total) // row.n
        if on_round is not None:
            on_round(done, moved)
        if moved == centroids:
            break
        centroids = moved
    return kept.mapInArrow(_assign(Bisectors(centroids), dims), schema), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia``, the distances summed over the cluster and over all."""
    assigned = cut_lineage(assigned)
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    total = sum(int(r.inertia) for r in each)  # one row a cluster
    sums = local_frame(
        assigned.sparkSession, [(r.cluster, int(r.inertia), total) for r in each], "cluster int, cluster_inertia bigint, inertia bigint"
    )
    return assigned.join(F.broadcast(sums), "cluster")
