"""Search over cells, stored blocks, sums of arrays and pair moments against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.operators import arrays as A
from tessaline.operators import neighbours as N
from tessaline.operators.cells import open_cells, write_cells

VECTORS = "id long, v array<double>"


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)], VECTORS)


def plain(q, r, k, q_ids=None, r_ids=None, exclude=True):
    q_ids = range(len(q)) if q_ids is None else q_ids
    r_ids = range(len(r)) if r_ids is None else r_ids
    sims = np.round(q @ r.T, 9)
    return {
        int(a): sorted((j for j in range(len(r)) if not exclude or r_ids[j] != a), key=lambda j: (-sims[i, j], r_ids[j]))[:k] for i, a in enumerate(q_ids)
    }


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def clumps(seed, n, size, centres, spread):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((centres, size)) * 10
    return middle[r.integers(0, centres, n)] + r.standard_normal((n, size)) * spread


@pytest.mark.parametrize("spread", [0.05, 20.0])
def test_search_over_cells(spark, spread):
    """Clumps and a cloud, with copies, a zero vector and vectors of very different norms."""
    m = clumps(2, 700, 6, 12, spread)
    m[50:90] = m[50]
    m[100] = 0
    m[101] *= 1000
    rows = frame(spark, m)
    assert found(N.top_k(rows, rows, 4, cells=10)) == plain(m, m, 4)


def test_cells_that_can_not_hold_a_neighbour_are_not_visited(spark):
    """Unit vectors in tight clumps: queries meet few of the 30 cells, and still find what all comparisons find."""
    m = clumps(5, 1500, 16, 30, 0.05)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cells = write_cells(frame(spark, m), cells=40)
    search = N.Search(cells, cells, spark, 5)
    first = search.own_cells().cache()
    visits = search.visits(first)
    asked = sum(len(r.q_ids) // 8 for r in visits.collect())
    assert asked < 0.05 * 1500 * (len(cells.radii) - 1)
    assert found(search.result()) == plain(m, m, 5)


def test_fewer_rows_in_a_cell_than_neighbours(spark):
    """Queries that don't find k in their own cell visit all others."""
    m = np.eye(7) * 3
    rows = frame(spark, m)
    assert found(N.top_k(rows, rows, 4, cells=7)) == plain(m, m, 4)


def test_queries_of_another_table(spark):
    q, r = clumps(7, 60, 5, 4, 0.3), clumps(8, 300, 5, 4, 0.3)
    made = N.top_k(frame(spark, q, range(1000, 1060)), frame(spark, r), 3, exclude_self=False, cells=6)
    assert found(made) == plain(q, r, 3, list(range(1000, 1060)), list(range(300)), False)


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (None, [1.0, 0.0]), (2, [0.5, 0.5])], VECTORS)
    assert found(N.top_k(rows, rows, 3)) == {0: [2], 2: [0]}
    none = rows.limit(0)
    assert N.top_k(none, none, 3).count() == 0


def test_stored_blocks_are_read_without_a_shuffle(spark, tmp_path):
    m = clumps(3, 400, 6, 5, 0.3)
    path = str(tmp_path / "stored blocks")
    write_cells(frame(spark, m), path, cells=4)
    cells = open_cells(spark, path)
    other = spark.range(cells.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(1).alias("x"))
    plan = cells.read(spark).hint("merge").join(other, "bucket")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1  # of the other side
    held = {}
    for r in cells.read(spark).collect():
        for i, v in zip(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.m, "<f8").reshape(r.n, -1), strict=True):
            held[int(i)] = v
    assert len(held) == 400 and all((held[i] == m[i]).all() for i in held)
    assert found(N.top_k(cells, cells, 3)) == plain(m, m, 3)


def test_sums_of_arrays(spark):
    """Many tasks and keys; a key with most rows is added up in parts."""
    r = np.random.default_rng(4)
    m, keys = r.integers(-5, 5, (900, 3)).astype(float), np.where(r.random(900) < 0.5, 0, r.integers(0, 40, 900))
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, m, strict=True)], "k long, v array<double>")
    for parts in (1, 7, 100):
        made = {x.k: x.sums for x in A.sum_arrays(rows.repartition(parts), "k", "v").collect()}
        assert made == {int(k): m[keys == k].sum(axis=0).tolist() for k in set(keys)}
    assert A.sum_arrays(rows.limit(0), "k", "v").count() == 0


def test_groups_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 13).alias("k"), F.array(F.col("id").cast("double")).alias("v"))
        made = {x.k: x.sums[0] for x in A.sum_arrays(rows, "k", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made == {k: float(sum(range(k, 500, 13))) for k in range(13)}


def test_pair_moments(spark):
    r = np.random.default_rng(6)
    m, labels = r.standard_normal((130, 5)), [None if i % 29 == 0 else i % 7 for i in range(130)]
    rows = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(m, labels, strict=True))], VECTORS + ", label int")
    made = {x.same_label: x for x in N.pair_similarity(rows.repartition(5)).collect()}
    for same in (True, False):
        sims = [m[i] @ m[j] for i in range(130) for j in range(i) if None not in (labels[i], labels[j]) and (labels[i] == labels[j]) == same]
        assert made[same].n == len(sims)
        assert (made[same].mean_sim, made[same].std_sim) == (pytest.approx(np.mean(sims)), pytest.approx(np.std(sims)))
    alone = N.pair_similarity(rows.filter("id = 1"))
    assert alone.count() == 0
    plan = N.pair_similarity(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 0


def test_neighbours_within_some_of_the_rows(spark):
    """Lists of a larger table are enough for most; who keeps too few is searched anew."""
    m = clumps(9, 200, 4, 3, 1.0)
    rows = frame(spark, m)
    fetched = N.top_k(rows, rows, 12).cache()
    for keep in (range(0, 200, 2), range(0, 200, 11), [3, 4, 5], [7]):
        ids = spark.createDataFrame([(i,) for i in keep], "id long")
        vectors = rows.join(ids, "id", "left_semi")
        sub = m[list(keep)]
        assert found(N.within(fetched, 12, ids, vectors, 5)) == {
            k: [list(keep)[j] for j in v] for k, v in plain(sub, sub, 5, list(keep), list(keep)).items() if v
        }


def test_queries_are_sent_once_a_slab(spark):
    """A cloud visits everything: queries go to a few slabs, not to each bucket, and bring back k rows from each at most."""
    m = clumps(9, 1200, 6, 1, 20.0)
    cells = write_cells(frame(spark, m), cells=24)
    assert cells.buckets >= 24
    search = N.Search(cells, cells, spark, 4)
    visits = search.visits(search.own_cells().cache())
    assert sum(len(r.q_ids) // 8 for r in visits.collect()) <= 4 * 1200
    assert found(search.result()) == plain(m, m, 4)


def test_a_bound_keeps_what_rounds_up_to_it(spark):
    """The least similarity of a block of queries doesn't lose rows that reach it only when rounded; ties go to smaller ids."""
    q, r = np.array([[1.0, 0.0]]), np.array([[0.5, 0.1], [0.5 - 4e-10, 0.2], [0.5 - 6e-10, 0.3]])
    kept = N._Kept(np.array([9]), q, np.array([0.5]), 3, True)
    kept.meet(np.array([7, 3, 1]), r, None)
    assert kept.rows().column("id").to_pylist() == [3, 7]


def test_blocks_go_to_a_task_once(spark, monkeypatch):
    """What the tasks of a search are given goes with rows times slabs and parts, not with pairs of blocks."""
    m = clumps(9, 1200, 6, 1, 20.0)
    cells = write_cells(frame(spark, m), cells=24)
    given, kind = [], type(spark.range(1))
    plain_map = kind.mapInArrow

    def spy(self, run, schema, *more):
        if schema == N._FOUND:
            given.append(self)
        return plain_map(self, run, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    made = N.Search(cells, cells, spark, 4).result()
    assert found(made) == plain(m, m, 4)
    binary = [F.coalesce(F.length(c), F.lit(0)) for c, t in given[-1].dtypes if t == "binary"]
    assert given[-1].agg(F.sum(sum(binary))).first()[0] <= 12 * 1200 * (6 * 8 + 8)


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e30])
def test_what_single_precision_cannot_tell(spark, scale):
    """Similarities apart by less than single precision has, copies, and lengths beyond its range."""
    r = np.random.default_rng(11)
    near = np.tile(r.standard_normal(8), (300, 1)) / 3 + r.standard_normal((300, 8)) * 1e-8
    m = np.concatenate([near, np.tile(r.standard_normal(8), (300, 1)), r.standard_normal((200, 8))]) * scale
    rows = frame(spark, m)
    if scale == 1.0:
        assert found(N.top_k(rows, rows, 4)) == plain(m, m, 4)
    else:  # products are all 0 to 9 digits, or too great for single precision
        made = {(x.query_id, x["rank"]): x.sim for x in N.top_k(rows, rows, 4).collect()}
        sims = m @ m.T
        np.fill_diagonal(sims, -np.inf)
        best = -np.sort(-sims, axis=1)[:, :4]
        assert len(made) == 800 * 4 and all(abs(v - best[q, k - 1]) <= 1e-9 * abs(best[q, k - 1]) + 1e-9 for (q, k), v in made.items())


def test_a_task_holds_few_bytes_of_long_vectors(spark, monkeypatch):
    """What a task holds, and the queries it gets, are bounded in bytes, however long the vectors are."""
    m = clumps(12, 1000, 64, 1, 20.0)
    cells = write_cells(frame(spark, m), cells=40)
    monkeypatch.setattr(N, "HELD", 32 * 1024)
    search = N.Search(cells, cells, spark, 3)
    assert search.each * m.nbytes / cells.buckets <= N.HELD and m.nbytes / search.parts <= 2 * N.HELD
    assert found(search.result()) == plain(m, m, 3)
