"""Exact nearest neighbours over cells of vectors, and what is measured on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.functions import vectors as V
from tessaline.operators.arrays import by_group, matrix, sum_arrays
from tessaline.operators.cells import Cells, write_cells
from tessaline.sources.shared import stored

#: Bytes of vectors that one task holds while the queries go by, about, and of the queries that it gets.
HELD = 32 << 20
#: Tasks a core that a search is cut into, about, unless there are more slabs and parts.
TASKS = 6

_FOUND = "query_id long, id long, sim double"


def centroid(rows: DataFrame) -> DataFrame:
    """One row: the normalised mean of `v`."""
    counted = rows.filter("v IS NOT NULL").select(F.lit(0).alias("g"), F.concat(F.array(F.lit(1.0)), "v").alias("v"))
    n = F.col("sums")[0]
    return sum_arrays(counted, "g", "v").select(V.unit(F.transform(F.slice("sums", 2, F.size("sums")), lambda x: x / n)).alias("centroid"))


def topic_drift(rows: DataFrame) -> DataFrame:
    """(id, topic_drift): 1 minus the product with the centroid."""
    return rows.crossJoin(F.broadcast(centroid(rows))).select("id", (1 - V.dot(F.col("v"), F.col("centroid"))).alias("topic_drift"))


def _slack(bound: np.ndarray) -> np.ndarray:
    """`bound` less what rounding to 9 digits and the last bits can add to a similarity."""
    return np.where(np.isfinite(bound), bound - (2e-9 + 1e-12 * np.abs(bound)), bound)


def _first_k(at: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each query stand: by similarity, ties by smaller ids."""
    order = np.lexsort((ids, -sims, at))
    return order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]


#: Vectors and their greatest norm, in single precision.
Single = tuple[np.ndarray, float]


def _single(m: np.ndarray) -> Single | None:
    """`m` in single precision; None where products could overflow there, or aren't numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = float(np.sqrt((m * m).sum(axis=1).max(initial=0.0)))
    return (m.astype(np.float32), most) if most < 1e18 else None


def _products(q: np.ndarray, r: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The inner products of q[at] and r[to], pair by pair; some thousand pairs are held at once."""
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    parts = [np.einsum("ij,ij->i", q[at[i : i + step]], r[to[i : i + step]]) for i in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _best(
    q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int, exclude_self: bool, least: np.ndarray,
    q_single: Single | None = None, r_single: Single | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query (its place), row and similarity of rows of `least` at least, all of the k best of each query among them.

    With both in single precision, products are found there first, and those that its error leaves in doubt are worked out exactly.
    """
    if rough := q_single is not None and r_single is not None:
        sims = q_single[0] @ r_single[0].T
        error = (q.shape[1] + 8) * 2.0**-23 * np.sqrt((q * q).sum(axis=1)) * r_single[1]
        bound = lambda: np.nextafter((_slack(least) - error).astype(np.float32), np.float32(-np.inf))
    else:
        sims, error, bound = q @ r.T, 0.0, lambda: _slack(least)
    hit = sims >= bound()[:, None]
    if len(r_ids) > k and np.count_nonzero(hit) > 4 * k * len(q_ids):
        if exclude_self and np.isin(q_ids, r_ids).any():
            sims[q_ids[:, None] == r_ids[None, :]] = -np.inf
        least = np.maximum(least, np.round(np.partition(sims, -k, axis=1)[:, -k].astype(np.float64) - error, 9))
        hit = sims >= bound()[:, None]
    at, to = np.divmod(np.flatnonzero(hit), len(r_ids))
    if exclude_self:
        other = q_ids[at] != r_ids[to]
        at, to = at[other], to[other]
    found = np.round(_products(q, r, at, to) if rough else sims[at, to], 9)
    good = (found >= least[at]) & (found > -np.inf)
    return at[good], r_ids[to[good]], found[good]


class _Kept:
    """The best `k` so far of a block of queries that meets one block of rows after the other."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, exclude_self: bool):
        self.q_ids, self.q, self.least, self.k, self.exclude_self = q_ids, q, least.copy(), k, exclude_self
        self.size, self.single = np.sqrt((q * q).sum(axis=1)), _single(q)
        self.at, self.ids, self.sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def reached(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """Which queries can find something in a cell: see `Search`."""
        slack = 2e-9 + 1e-12 * self.size * (np.sqrt((centre * centre).sum()) + radius)
        return self.q @ centre + self.size * max(radius, 0.0) + slack >= self.least

    def meet(self, r_ids: np.ndarray, r: np.ndarray, cell: tuple[np.ndarray, float] | None, r_single: Single | None = None) -> None:
        some = slice(None) if cell is None else np.flatnonzero(self.reached(*cell))
        if cell is None or len(some):
            single = self.single and (self.single[0][some], self.single[1])
            at, ids, sims = _best(self.q_ids[some], self.q[some], r_ids, r, self.k, self.exclude_self, self.least[some], single, r_single)
            at = at if cell is None else some[at]
            self.at, self.ids, self.sims = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.sims, sims])
            if len(self.at) > 2 * self.k * len(self.q_ids):
                self.cut()

    def cut(self) -> None:
        keep = _first_k(self.at, self.ids, self.sims, self.k)
        self.at, self.ids, self.sims = self.at[keep], self.ids[keep], self.sims[keep]
        last = np.flatnonzero(np.bincount(self.at, minlength=len(self.q_ids)) == self.k)
        ends = np.searchsorted(self.at, last, side="right") - 1
        self.least[last] = np.maximum(self.least[last], self.sims[ends])

    def rows(self) -> pa.RecordBatch:
        self.cut()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.q_ids[self.at], self.ids, self.sims)], names=["query_id", "id", "sim"])


def _compare(rows: DataFrame, asked: DataFrame | None, tile: str, tiles: int, k: int, exclude_self: bool, cells: Broadcast | None = None) -> DataFrame:
    """(query_id, id, sim): the best `k` of what each block of queries finds in its tile, a task each.

    `rows`: blocks (tile, bucket, cell, ids, m); `asked`: blocks of queries (tile, bucket, ids, m, least: bytes of doubles, or null), or
    None where the rows of each tile are its queries. A task gets the rows first and holds them, then the queries go by; no
    block goes to it twice. `cells` (centres, radii): queries that can find nothing in the cell of a block aren't compared with it.
    """
    columns = [F.col(tile).cast("int").alias("tile"), "asks", "bucket", "cell", "ids", "m", "least"]
    both = rows.withColumn("asks", F.lit(False)).withColumn("least", F.lit(None).cast("binary")).select(*columns)
    mutual = asked is None
    if not mutual:
        both = both.unionByName(asked.withColumn("asks", F.lit(True)).withColumn("cell", F.lit(None).cast("int")).select(*columns))

    def answer(ids: np.ndarray, m: np.ndarray, least: bytes | None, held: list[tuple]) -> pa.RecordBatch:
        bound = np.full(len(ids), -np.inf) if least is None else np.frombuffer(least, dtype="<f8")
        kept = _Kept(ids, m, bound, k, exclude_self)
        for r_ids, r, single, c in held:
            kept.meet(r_ids, r, (cells.value[0][c], float(cells.value[1][c])) if cells else None, single)
        return kept.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                this, asks, c, ids, m, least = (batch.column(x)[i].as_py() for x in ("tile", "asks", "cell", "ids", "m", "least"))
                if there != this:
                    if mutual:
                        yield from (answer(*h[:2], None, held) for h in held)
                    there, held = this, []
                m = np.frombuffer(m, dtype="<f8").reshape(len(ids) // 8, -1)
                ids = np.frombuffer(ids, dtype="<i8")
                if asks:
                    yield answer(ids, m, least, held)
                else:
                    held.append((ids, m, _single(m), c))
        if mutual:
            yield from (answer(*h[:2], None, held) for h in held)

    dealt = both.repartitionById(tiles, F.col("tile")).sortWithinPartitions("tile", "asks", "bucket")
    return dealt.select("tile", "asks", "cell", "ids", "m", "least").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Search:
    """The `k` rows of the greatest inner product with each query, over `rows` stored as cells.

    First each query meets the rows of one bucket of its own cell; the k-th similarity so
    far goes with it. A row of a cell with centre c and radius r has a product of at most
    q.c + |q| r with a query q, so that only those cells can matter where this isn't below
    the query's k-th similarity. Buckets stand together in slabs, and `visits` sends a query
    once to each slab that has such a cell; there the cells are told apart again. Each
    slab is met by several `parts` of the queries, a task each, so that queries are moved once a
    slab and rows once a part. There are about as many slabs as parts, a number that goes with the cores, not
    with the rows, until a slab has `HELD` bytes. Vectors without structure visit all slabs.
    """

    def __init__(self, queries: Cells, rows: Cells, spark: SparkSession, k: int, exclude_self: bool = True):
        self.queries, self.rows, self.k, self.exclude_self, self.spark = queries, rows, k, exclude_self, spark
        tasks = TASKS * spark.sparkContext.defaultParallelism
        of_held = lambda c: max(1, int(HELD * c.buckets // max(1, c.total * c.centres.shape[1] * 8)))  # noqa: E731  buckets
        self.each = min(of_held(rows), -(-rows.buckets // math.isqrt(tasks)))
        self.slabs = -(-rows.buckets // self.each)
        self.parts = min(queries.buckets, max(-(-tasks // self.slabs), -(-queries.buckets // of_held(queries))))
        firsts = np.searchsorted(rows.of_bucket, np.arange(len(rows.radii)))  # buckets stand by cell
        there = [(int(c), int(firsts[c])) for c in range(len(rows.radii)) if rows.radii[c] >= 0]
        self.places = spark.createDataFrame(there, "cell int, bucket int")  # a row a cell
        self.blocks = rows.read(spark).select("bucket", "cell", "ids", "m")
        self.asked = queries.read(spark).select("cell", F.col("bucket").alias("q_bucket"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))

    def own_cells(self) -> DataFrame:
        """What each query finds in its own bucket, or in the first of its own cell."""
        rows, asked = self.blocks, None
        if self.queries is not self.rows:
            rows = rows.join(F.broadcast(self.places.select("bucket")), "bucket", "left_semi")
            asked = self.asked.join(F.broadcast(self.places), "cell").select("bucket", F.col("q_ids").alias("ids"), F.col("q_m").alias("m"))
            asked = asked.withColumn("least", F.lit(None).cast("binary"))
        return _ranked(_compare(rows, asked, "bucket", self.rows.buckets, self.k, self.exclude_self), self.k)

    def visits(self, first: DataFrame) -> DataFrame:
        """(slab, q_bucket, q_ids, q_m, least): the slabs with a cell that can hold one of the k best, and the queries it can hold one for."""
        k, radii = self.k, self.rows.radii
        sent = self.spark.sparkContext.broadcast((self.rows.centres, radii))  # a vector a cell
        slab_of = np.arange(self.rows.buckets) // self.each
        of_slab = [np.unique(self.rows.of_bucket[slab_of == s]) for s in range(self.slabs)]  # the cells of each slab
        kth = first.filter(F.col("rank") == k).select("query_id", F.col("sim").alias("least"))

        def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column("q_ids")[i].as_py(), dtype="<i8")
                    buckets = np.full(len(ids), batch.column("q_bucket")[i].as_py(), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ids)], names=["q_bucket", "query_id"])

        asked = self.asked.select("q_bucket", "q_ids").mapInArrow(ids_of, "q_bucket int, query_id long")
        limits = asked.join(kth, "query_id").groupBy("q_bucket").agg(F.collect_list(F.struct("query_id", "least")).alias("limits"))  # a bucket's

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radii = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column("q_ids")[i].as_py(), dtype="<i8")
                    q = np.frombuffer(batch.column("q_m")[i].as_py(), dtype="<f8").reshape(len(ids), -1)
                    least = np.full(len(ids), -np.inf)
                    known = batch.column("limits")[i].as_py() or []
                    if known:
                        names = np.array([x["query_id"] for x in known], dtype=np.int64)
                        order = np.argsort(names)
                        values = np.array([x["least"] for x in known])[order]
                        at = np.minimum(np.searchsorted(names[order], ids), len(names) - 1)
                        least = np.where(names[order][at] == ids, values[at], -np.inf)
                    if len(radii) == 1:
                        need = np.ones((len(ids), 1), dtype=bool)
                    else:
                        size = np.sqrt((q * q).sum(axis=1))[:, None]
                        most = q @ centres.T + size * np.maximum(radii, 0)[None, :]
                        slack = 2e-9 + 1e-12 * size * (np.sqrt((centres * centres).sum(axis=1)) + radii)[None, :]
                        need = (most + slack >= least[:, None]) & (radii >= 0)[None, :]
                    into = [need[:, c].any(axis=1) for c in of_slab]
                    slabs = [s for s, n in enumerate(into) if n.any()]
                    columns = [[x[into[s]].tobytes() for s in slabs] for x in (ids, q, least)]
                    buckets = pa.array(np.full(len(slabs), batch.column("q_bucket")[i].as_py(), dtype=np.int32))
                    arrays = [pa.array(slabs, pa.int32()), buckets, *[pa.array(c, pa.binary()) for c in columns]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["slab", "q_bucket", "q_ids", "q_m", "least"])

        joined = self.asked.join(limits, "q_bucket", "left").select("q_bucket", "q_ids", "q_m", "limits")
        return joined.mapInArrow(run, "slab int, q_bucket int, q_ids binary, q_m binary, least binary")

    def result(self) -> DataFrame:
        """(query_id, id, sim, rank)."""
        if self.rows.buckets == 1 and self.rows.radii[0] >= 0 and self.queries.buckets == 1:
            return self.own_cells()
        first = stored(self.own_cells())
        tile = F.col("slab") * self.parts + F.col("part")
        asked = self.visits(first).withColumn("part", F.pmod(F.col("q_bucket"), F.lit(self.parts)))
        asked = asked.select(tile.alias("tile"), F.col("q_bucket").alias("bucket"), F.col("q_ids").alias("ids"), F.col("q_m").alias("m"), "least")
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        blocks = self.blocks.select("*", F.floor(F.col("bucket") / self.each).cast("int").alias("slab"), parts).withColumn("tile", tile)
        cells = None
        if len(self.rows.radii) > 1:
            cells = self.spark.sparkContext.broadcast((self.rows.centres, self.rows.radii))
        return _ranked(_compare(blocks, asked, "tile", self.slabs * self.parts, self.k, self.exclude_self, cells), self.k)


def top_k(queries: DataFrame | Cells, rows: DataFrame | Cells, k: int, exclude_self: bool = True, cells: int | None = None) -> DataFrame:
    """(query_id, id, sim, rank): the `k` rows of the greatest inner product with each query.

    Both are (id, v), or stored cells (of the same centres). Similarities are rounded to 9 digits; ties go
    to smaller ids. Exact: see `Search`. Rows without a vector take no part.
    """
    frame = rows if isinstance(rows, DataFrame) else queries if isinstance(queries, DataFrame) else None
    spark = frame.sparkSession if frame is not None else SparkSession.active()
    usable = lambda df: df.select(F.col("id").cast("long").alias("id"), "v").filter("id IS NOT NULL AND v IS NOT NULL")
    there = rows if isinstance(rows, Cells) else write_cells(usable(rows), cells=cells)
    if queries is rows:
        return Search(there, there, spark, k, exclude_self).result()
    asked = queries if isinstance(queries, Cells) else write_cells(usable(queries), like=there)
    return Search(asked, there, spark, k, exclude_self).result()


def rerank(fetched: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`top_k`'s columns: of each query's `fetched` rows (query_id, id) the best `k` by the vectors given here."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        v, rank = matrix(table.column("v")), table.column("rank").to_numpy()
        own = np.repeat(starts, np.diff([*starts, len(rank)]))
        hits = (rank > 0) & (rank[own] == 0)
        sims = np.round((v[hits] * v[own[hits]]).sum(axis=1), 9)
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("query_id").to_numpy()[hits]), pa.array(table.column("id").to_numpy()[hits]), pa.array(sims)], names=["query_id", "id", "sim"]
        )

    both = _with_query(fetched.withColumn("rank", F.lit(1)), queries, rows)
    return _ranked(by_group(both, "query_id", ["rank", "id"], run, _FOUND), k)


def within(fetched: DataFrame, depth: int, members: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """`top_k`'s columns among `members` (id) alone, as queries and rows, from the `depth` nearest of a larger table.

    What isn't a member is dropped; a query that keeps fewer than `k` of a full list may have nearer members further down, and
    is searched anew among `vectors` (id, v), those of the members.
    """
    members = members.select("id").hint("merge")
    mine = fetched.join(members.withColumnRenamed("id", "query_id").hint("merge"), "query_id", "left_semi").join(members, "id", "left_semi")
    kept = stored(_ranked(mine.select("query_id", "id", "sim"), k))
    lists = fetched.groupBy(F.col("query_id").alias("id")).agg((F.count("*") == depth).alias("full"))
    counts = kept.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    short = members.join(lists.filter("full"), "id").join(counts.hint("merge"), "id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    short = stored(short.select("id"))
    if short.isEmpty():
        return kept
    again = top_k(vectors.join(short, "id", "left_semi"), vectors, k)
    return kept.join(short.withColumnRenamed("id", "query_id").hint("merge"), "query_id", "left_anti").select(*again.columns).unionByName(again)


def _with_query(neighbours: DataFrame, queries: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(query_id, rank, id, v): the neighbours with their vectors, and each query's own vector at rank 0."""
    members = neighbours.select("query_id", "rank", "id").join(rows.select("id", "v").hint("merge"), "id").select("query_id", "rank", "id", "v")
    if queries is None:
        return members
    return members.unionByName(queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id"), "v").filter("v IS NOT NULL"))


def coherence(neighbours: DataFrame, rows: DataFrame, default: float = 0.5) -> DataFrame:
    """(query_id, cluster_coh): the mean inner product among a query's neighbours; `default` with fewer than two.

    By the closed form (|sum|^2 - sum of |e|^2) / (k (k - 1)).
    """

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        v = matrix(table.column("v"))
        k = np.diff([*starts, len(v)])
        total, own = np.add.reduceat(v, starts, axis=0), np.add.reduceat((v * v).sum(axis=1), starts)
        value = np.where(k > 1, ((total * total).sum(axis=1) - own) / np.maximum(k * (k - 1), 1), default)
        return pa.RecordBatch.from_arrays([pa.array(table.column("query_id").to_numpy()[starts]), pa.array(value)], names=["query_id", "cluster_coh"])

    return by_group(_with_query(neighbours, None, rows), "query_id", ["rank"], run, "query_id long, cluster_coh double")


def retrieved_deviation(neighbours: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id, geo, attn, a_score): distance to the centre of what the query retrieved, 1 minus the
    product with the query, and 0.6 and 0.4 of them."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        v, rank = matrix(table.column("v")), table.column("rank").to_numpy()
        sizes = np.diff([*starts, len(v)])
        own = np.repeat(starts, sizes)
        hits = rank > 0
        means = np.add.reduceat(v * hits[:, None], starts, axis=0) / np.maximum(np.add.reduceat(hits.astype(np.int64), starts), 1)[:, None]
        norms = np.sqrt((means * means).sum(axis=1))
        means = means / np.where(norms > 1e-9, norms, 1.0)[:, None]
        step = v - np.repeat(means, sizes, axis=0)
        geo, attn = np.sqrt((step * step).sum(axis=1)), 1 - (v * v[own]).sum(axis=1)
        hits &= rank[own] == 0
        columns = [table.column("query_id").to_numpy(), table.column("id").to_numpy(), geo, attn, 0.6 * geo + 0.4 * attn]
        return pa.RecordBatch.from_arrays([pa.array(c[hits]) for c in columns], names=["query_id", "id", "geo", "attn", "a_score"])

    both = _with_query(neighbours, queries, rows)
    return by_group(both, "query_id", ["rank"], run, "query_id long, id long, geo double, attn double, a_score double")


def _moments(v: np.ndarray) -> np.ndarray:
    """Of vectors: their number, the sums of |x|^2 and |x|^4, the sum, and the matrix of second moments, row by row."""
    own = (v * v).sum(axis=1)
    return np.concatenate([[len(v), own.sum(), (own * own).sum()], v.sum(axis=0), (v.T @ v).reshape(-1)])


def _pair_terms(moments: DataFrame) -> DataFrame:
    """(n, s, ss): number, sum and sum of squares of the products of all pairs, from rows of `sums`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("sums"))
            if len(m):
                n, one, two = m[:, 0], m[:, 1], m[:, 2]
                d = int(np.sqrt(m.shape[1] - 3 + 0.25))
                total, square = m[:, 3 : 3 + d], m[:, 3 + d :]
                pairs = np.round(n * (n - 1) / 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs), pa.array(((total * total).sum(axis=1) - one) / 2), pa.array(((square * square).sum(axis=1) - two) / 2)], names=["n", "s", "ss"]
                )

    return moments.select("sums").mapInArrow(run, "n long, s double, ss double")


def pair_similarity(rows: DataFrame) -> DataFrame:
    """(same_label, n, mean_sim, std_sim): inner products of all pairs, by whether labels agree; no pair is ever made.

    With s = sum of x and M = sum of x x', the products of all pairs add up to (|s|^2 - sum of |x|^2) / 2, and their
    squares to (|M|^2 - sum of |x|^4) / 2. One pass adds up both by label; all labels together give all pairs, and
    what isn't within a label is between labels. Rows without a label or vector take no part.
    """
    usable = rows.filter("label IS NOT NULL AND v IS NOT NULL").select("label", "v")
    by_label = stored(sum_arrays(usable, "label", "v", _moments))
    within = _pair_terms(by_label).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "s", "ss")])
    every = _pair_terms(sum_arrays(by_label.select(F.lit(0).alias("g"), "sums"), "g", "sums"))
    same = within.select(F.lit(True).alias("same_label"), "n", "s", "ss")
    apart = every.crossJoin(within.select(*[F.col(c).alias(f"w_{c}") for c in within.columns])).select(  # one row each
        F.lit(False).alias("same_label"), *[(F.col(c) - F.col(f"w_{c}")).alias(c) for c in ("n", "s", "ss")]
    )
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return same.unionByName(apart).filter("n > 0").select("same_label", F.col("n").cast("long").alias("n"), mean.alias("mean_sim"), spread.alias("std_sim"))
