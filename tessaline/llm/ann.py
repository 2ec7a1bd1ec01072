"""Nearest neighbours over randomly rotated one-bit codes, with error bounds that choose what to rerank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.llm.common import Written, spread

#: Rows in a block of the index, and queries in a block of questions.
ROWS, QUERIES = 8192, 1024
#: Rows of one stripe of the index, about: a task compares a stripe with all questions of its length.
STRIPE = 1 << 20
_BLOCKS = "size int, stripe int, ids binary, codes binary, norms binary, scale binary, vectors binary"


@lru_cache(maxsize=8)
def rotation(size: int, seed: int = 9) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def turned(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors from the centre, and the distances from it."""
    moved = vectors - centre
    norms = np.sqrt((moved * moved).sum(axis=1))
    unit = np.divide(moved, norms[:, None], out=np.zeros_like(moved), where=norms[:, None] > 0)
    return unit @ rotation(vectors.shape[1]), norms


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance from the centre, and the correction <code, vector> of each row."""
    unit, norms = turned(vectors, centre)
    return np.packbits(unit > 0, axis=1), norms, np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])


class Questions:
    """Queries made ready: for each byte of a code and each of its 256 values what it adds to the inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, width: float):
        self.ids, self.vectors, self.width, self.size = ids, vectors, width, vectors.shape[1]
        unit, self.norms = turned(vectors, centre)
        padded = np.zeros((len(ids), -(-self.size // 8) * 8), dtype=np.float32)
        padded[:, : self.size] = unit
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
        self.adds = padded.reshape(len(ids), -1, 8) @ signs.T  # query, byte, value

    def bounds(self, q: int, codes: np.ndarray, norms: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of a query's squared distances, from packed codes and their scalars alone."""
        inner = np.zeros(len(codes), dtype=np.float32)
        for byte in range(codes.shape[1]):
            inner += self.adds[q, byte][codes[:, byte]]
        safe = np.maximum(scale, 1e-9)
        inner = inner / np.float32(np.sqrt(self.size)) / safe
        error = self.width * np.sqrt(np.maximum(0, 1 - scale * scale)) / safe / np.sqrt(max(1, self.size - 1)) + 1e-4
        base, span = self.norms[q] ** 2 + norms**2, 2 * self.norms[q] * norms
        slack = 1e-6 * (base + 1e-30)
        return base - span * np.minimum(1, inner + error) - slack, base - span * np.maximum(-1, inner - error) + slack


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part: id and vector not null, finite, not all zero."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def _distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order.

    Where a square overflows, the components are scaled first; a distance that no double
    holds is infinite.
    """
    total = np.zeros(len(rows))
    for i in range(len(query)):
        step = query[i] - rows[:, i]
        total += step * step
    wide = np.flatnonzero(~np.isfinite(total))
    far = np.sqrt(total)
    if len(wide):
        half = np.abs(query / 2 - rows[wide] / 2)
        most = half.max(axis=1)
        far[wide] = 2 * (most * np.sqrt(((half / most[:, None]) ** 2).sum(axis=1)))
    return far


class Nearest:
    """The k nearest so far of each question, over blocks of rows that come one by one; `reranked` counts exact distances."""

    def __init__(self, questions: Questions, k: int):
        self.questions, self.k, self.reranked = questions, k, 0
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(questions.ids)

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, scale: np.ndarray, rows: np.ndarray) -> None:
        """Rerank of each question the rows whose lower bound isn't over the k-th smallest upper bound or distance."""
        k = self.k
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for q in range(len(self.questions.ids)):
                low, high = self.questions.bounds(q, codes, norms, scale)
                other = ids != self.questions.ids[q]
                best_ids, best = self.best[q]
                limit = best[-1] ** 2 * (1 + 1e-9) if len(best) == k else np.inf
                if other.sum() > k:
                    bound = np.partition(high[other], k - 1)[k - 1]
                    limit = limit if np.isnan(bound) else min(limit, bound)
                take = np.flatnonzero(~(low > limit) & other)  # a bound that overflowed says nothing
                if len(take):
                    self.reranked += len(take)
                    far = np.concatenate([best, _distances(self.questions.vectors[q], rows[take])])
                    found = np.concatenate([best_ids, ids[take]])
                    order = np.lexsort((found, far))[:k]
                    self.best[q] = found[order], far[order]

    def result(self) -> pa.RecordBatch:
        query = np.repeat(self.questions.ids, [len(i) for i, _ in self.best])
        ids = np.concatenate([i for i, _ in self.best]) if len(query) else np.zeros(0, dtype=np.int64)
        far = np.concatenate([d for _, d in self.best]) if len(query) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(far)], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _runs(batches: Iterator[pa.RecordBatch], most: int, *keys: str) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Parts of up to `most` rows that agree in `keys`, by which rows are sorted."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:], strict=False):
            for begin in range(first, last, most):
                yield batch.slice(begin, min(most, last - begin)), tuple(int(c[begin]) for c in columns)


class Index:
    """Codes, scalars and vectors of (id, v) rows in stored blocks, for any number of searches.

    `centres` are the means of about `sample` rows, picked by a hash of the id, by length of
    vector; lengths that none of them has keep zero. All rows are coded. Each length has
    stripes of about `stripe` rows, picked by a hash of the id and vector: what a task compares with questions.
    """

    def __init__(self, rows: DataFrame, sample: int = 50_000, width: float = 4.0, stripe: int = STRIPE):
        spark, self.width = rows.sparkSession, width
        sized = spread(rows).withColumn("size", F.size("v"))
        sizes = {r.size: r.n for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row a length
        total = sum(sizes.values())
        share = int(min(1.0, sample / max(1, total)) * (1 << 20)) or 1
        picked = sized.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
        self.centres = {s: np.zeros(s) for s in sizes}
        for r in picked.select("size", F.posexplode("v").alias("i", "x")).groupBy("size", "i").agg(F.avg("x").alias("x")).collect():
            if np.isfinite(r.x):
                self.centres[r.size][r.i] = r.x
        cores = spark.sparkContext.defaultParallelism
        self.shares = {s: max(1, -(-n // stripe), min(cores, n // ROWS)) for s, n in sizes.items()}
        self.spark, centres = spark, self.centres

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore", invalid="ignore"):
                for part, (size, stripe) in _runs(batches, ROWS, "size", "stripe"):
                    v = _matrix(part.column("v"), size)
                    made = [part.column("id").to_numpy(), *encode(v, centres[size]), v]
                    kinds = ["<i8", "u1", "<f8", "<f8", "<f8"]
                    blobs = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(made, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([stripe], pa.int32()), *blobs], names=[f.split()[0] for f in _BLOCKS.split(", ")])

        table = spark.createDataFrame(list(self.shares.items()) or [(0, 1)], "size int, share int")
        dealt = sized.join(F.broadcast(table), "size").withColumn("stripe", F.pmod(F.xxhash64("id", "v"), F.col("share")).cast("int"))  # a row a length
        parts = max(1, sum(self.shares.values()))
        dealt = dealt.repartition(parts, "size", "stripe").sortWithinPartitions("size", "stripe", "id").select("size", "stripe", "id", "v")
        self.blocks = Written(dealt.mapInArrow(code, _BLOCKS), "codes").df

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The `k` nearest rows of each of `queries` (id, v): query_id, rank (from 1), vec_id, score (Euclidean distance).

        A row with a query's id is not its candidate; rows of another length aren't either. Ties go to smaller ids. Queries go in
        blocks to every stripe of their length, a task keeps the k best of each, so that at most k
        rows a query and stripe meet in the final ranking. Rows that repeat an id are
        candidates each; queries that repeat an id count once for each length (the first
        by vector). An empty table, of rows or queries, gives none.
        """
        centres, width = self.centres, self.width
        wanted = queries.groupBy(F.size("v").alias("size"), "id").agg(F.min("v").alias("v"))
        table = self.spark.createDataFrame(list(self.shares.items()) or [(0, 1)], "size int, share int")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, (size,) in _runs(batches, QUERIES, "size"):
                blobs = [part.column("id").to_numpy().astype("<i8").tobytes(), _matrix(part.column("v"), size).astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["size", "q_ids", "q_vectors"])

        asked = wanted.join(F.broadcast(table), "size").select("size", "id", "v").sortWithinPartitions("size", "id").mapInArrow(pack, "size int, q_ids binary, q_vectors binary")
        asked = asked.withColumn("question", F.xxhash64("q_ids"))
        visits = asked.join(F.broadcast(table), "size").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("share") - 1))).drop("share")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), dtype=t)  # noqa: E731, B023
                    size, key = batch.column("size")[i].as_py(), batch.column("question")[i].as_py()
                    q_ids, ids = get("q_ids", "<i8"), get("ids", "<i8")
                    if held is None or (size, key) != at or not np.array_equal(held.questions.ids, q_ids):
                        if held is not None:
                            yield held.result()
                        questions = Questions(q_ids, get("q_vectors", "<f8").reshape(len(q_ids), size), centres[size], width)
                        held, at = Nearest(questions, k), (size, key)
                    held.add(ids, get("codes", "u1").reshape(len(ids), -1), get("norms", "<f8"), get("scale", "<f8"), get("vectors", "<f8").reshape(len(ids), size))
            if held is not None:
                yield held.result()

        pairs = visits.join(self.blocks, ["size", "stripe"]).sortWithinPartitions("size", "question", "stripe")
        found = pairs.select("size", "question", "q_ids", "q_vectors", "ids", "codes", "norms", "scale", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, width: float = 4.0) -> DataFrame:
    """`Index.search` over an index made of `rows`; both tables are (id, v) as `usable` gives them."""
    return Index(rows, width=width).search(queries, k)


def op9(embeddings: DataFrame) -> DataFrame:
    """The 10 nearest of each row whose vec_id is divisible by 100. An empty table gives no row."""
    rows = usable(embeddings)
    return search(rows, rows.filter(F.col("id") % 100 == 0), k=10)
