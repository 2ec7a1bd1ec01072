"""Clusters around integer centroids, by annulus search over centroids sorted by norm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, spread

#: Components up to this are squared and summed as 64-bit integers; beyond it Python's own integers are used.
PLAIN = 1 << 27
#: Components from this on don't take part.
LARGEST = 1 << 62
_LONG = (1 << 63) - 1
#: Vectors compared at once.
_ROWS = 8192


class Centroids:
    """Integer centroids in the order of their norms; number i is the i-th row of `points`."""

    def __init__(self, points: np.ndarray):
        self.wide = bool(len(points)) and max(abs(int(points.max())), abs(int(points.min()))) > PLAIN
        norms = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        self.numbers = np.argsort(norms, kind="stable")
        self.norms, self.points = norms[self.numbers], points[self.numbers]

    def annulus(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row a first centroid, its squared distance, and the run [low, high) of centroids that can be as near.

        The distance to the centroid of the nearest norm is an upper bound u; a centroid
        at u or less has a norm within u of the row's. The run is widened by what double
        precision may lose, so that ties at its edges are in it.
        """
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        after = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        first = np.where(np.abs(self.norms[before] - norms) <= np.abs(self.norms[after] - norms), before, after)
        step = rows - self.points[first]
        far = (step * step).sum(axis=1)
        bound = np.sqrt(far.astype(np.float64))
        bound += 1e-9 * (norms + bound + 1)
        return first, far, np.searchsorted(self.norms, norms - bound), np.searchsorted(self.norms, norms + bound, side="right")

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of integers: the number of the nearest centroid (ties: the smaller), the squared distance, and
        how many centroids it was compared with."""
        if self.wide or (len(rows) and max(abs(int(rows.max())), abs(int(rows.min()))) > PLAIN):
            rows = rows.astype(object)
            self.points = self.points.astype(object)
        first, far, low, high = self.annulus(rows)
        best = self.numbers[first]
        for j in range(int(low.min(initial=0)), int(high.max(initial=0))):
            at = np.flatnonzero((low <= j) & (j < high) & (first != j))
            if not len(at):
                continue
            step = rows[at] - self.points[j]
            there, number = (step * step).sum(axis=1), self.numbers[j]
            nearer = (there < far[at]) | ((there == far[at]) & (number < best[at]))
            at = at[nearer]
            best[at], far[at] = number, there[nearer]
        return best, far, np.maximum(high - low, 1)


def quantised(vectors: DataFrame, size: int, scale: float = 1024.0, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, q): vectors of `size` components, none null or not finite, as floor(scale * x), x as double.

    Vectors with a component whose integer is 2^62 or more, either way, are left out too.
    """
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(LARGEST)))
    kept = vectors.filter((F.size(v) == size) & fine)
    return kept.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("q"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` rows of the smallest sha256 of `seed:id`, in that order (then by vector; rows without an id last)."""
    key = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("~"))
    return np.array([r.q for r in rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()], dtype=np.int64)


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, _ROWS):
            part = batch.slice(begin, _ROWS)
            yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def moved(rows: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of what is nearest to each, by component; empty ones stay.

    Each task sums its own rows in integers that can't overflow; a sum a task, centroid
    and component goes on.
    """
    sent = rows.sparkSession.sparkContext.broadcast(points)  # k times size integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, size = Centroids(sent.value), sent.value.shape[1]
        counts, sums = {}, {}
        for _, q in _portions(batches, size):
            best = centroids.nearest(q)[0]
            for number in np.unique(best).tolist():
                mine = q[best == number]
                wide = max(abs(int(mine.max())), abs(int(mine.min()))) > PLAIN
                total = mine.astype(object).sum(axis=0) if wide else mine.sum(axis=0).astype(object)
                counts[number] = counts.get(number, 0) + len(mine)
                sums[number] = sums[number] + total if number in sums else total
        columns = [
            pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()),
            pa.array([[str(x) for x in sums[c]] for c in counts], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    found = rows.mapInArrow(run, "cluster int, n long, sums array<string>").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    total = found.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    after = points.copy()
    for r in total.collect():  # k times size at most
        after[r.cluster, r.i] = int(r.x) // r.n
    sent.destroy()
    return after


def assigned(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """(id, cluster, distance, compared) of each of `rows` (id, q): the nearest of `points`, the squared distance (null
    where a long can't hold it), and the number of centroids in the row's annulus."""
    sent = rows.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(sent.value)
        for part, q in _portions(batches, sent.value.shape[1]):
            best, far, compared = centroids.nearest(q)
            far = [x if x <= _LONG else None for x in far.tolist()]
            columns = [part.column("id"), pa.array(best, pa.int32()), pa.array(far, pa.int64()), pa.array(compared, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "compared"])

    return rows.mapInArrow(run, "id long, cluster int, distance long, compared int")


def cluster(rows: DataFrame, k: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """`assigned` after `rounds` rounds over `rows` (id, q), stored, and the centroids by number.

    The quantised vectors are stored once and read in each round; nothing but sums by
    centroid is shuffled, and only the centroids (`k` of them) meet in the driver.
    Fewer than `k` rows make fewer centroids. Repeated rows count each; rows without an
    id are assigned too.
    """
    held = Written(spread(rows), "quantised")
    points = starts(held.df, k, seed)
    if not len(points):
        return held.df.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared")), points
    for _ in range(rounds):
        points = moved(held.df, points)
    made = Written(assigned(held.df, points), "assigned").df
    held.drop()
    return made, points


def op12(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept.

    Vectors of another length than 64, or with null or infinite components, and null
    vectors have no row; an empty table gives none. Rows that repeat a vec_id, or have
    none, have a row each. A distance or sum that a long can't hold is null.
    """
    made, points = cluster(quantised(embeddings, 64), 8, 10, 3)
    spark = embeddings.sparkSession
    prints = [(i, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for i, p in enumerate(points.tolist())]
    whole = lambda x: F.when(F.bool_and(F.col(x).isNotNull()), F.sum(F.col(x).cast("decimal(38,0)")))
    by_cluster = made.groupBy("cluster").agg(whole("distance").alias("sum"))
    every = by_cluster.agg(whole("sum").alias("all"))
    sums = by_cluster.crossJoin(F.broadcast(every)).join(spark.createDataFrame(prints, "cluster int, centroid_sha256 string"), "cluster")
    return made.join(F.broadcast(sums), "cluster").select(  # a row for each centroid
        F.col("id").alias("vec_id"), "cluster", "distance", F.col("sum").try_cast("long").alias("cluster_inertia"),
        F.col("all").try_cast("long").alias("inertia"), "centroid_sha256",
    )
