"""Packed codes, their bounds, and searches over a stored index."""

import numpy as np
import pytest

from tessaline.llm import ann

VECTORS = "id long, v array<double>"


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], VECTORS)


def nearest(q, rows, k, own=None):
    far = np.sqrt(((rows - q) ** 2).sum(axis=1))
    return [int(j) for j in np.lexsort((np.arange(len(rows)), far)) if j != own][:k]


def found(made):
    out = {}
    for r in sorted(made.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64])
def test_bounds_from_packed_bits(size):
    """The estimate from bytes of bits is that from single bits, and nearly all true distances are between the bounds."""
    r = np.random.default_rng(size)
    rows, queries, centre = r.standard_normal((400, size)), r.standard_normal((20, size)), r.standard_normal(size) * 0.1
    codes, norms, scale = ann.encode(rows, centre)
    assert codes.shape == (400, -(-size // 8)) and codes.dtype == np.uint8
    questions = ann.Questions(np.arange(20), queries, centre, 4.0)
    unit, _ = ann.turned(queries, centre)
    signs = np.unpackbits(codes, axis=1, count=size).astype(float) * 2 - 1
    outside = 0
    for q in range(20):
        low, high = questions.bounds(q, codes, norms, scale)
        inner = sum(questions.adds[q, b][codes[:, b]] for b in range(codes.shape[1]))
        assert np.allclose(inner, signs @ unit[q], atol=1e-4)
        true = ((rows - queries[q]) ** 2).sum(axis=1)
        outside += int(((true < low - 1e-9) | (true > high + 1e-9)).sum())
    assert outside <= 20 * 400 * 0.001


def test_bounds_choose_what_is_reranked():
    r = np.random.default_rng(1)
    middle = r.standard_normal((40, 64)) * 5
    rows = middle[r.integers(0, 40, 8000)] + r.standard_normal((8000, 64)) * 0.3
    centre = rows.mean(axis=0)
    best = ann.Nearest(ann.Questions(np.arange(30), rows[:30], centre, 4.0), 10)
    for begin in range(0, 8000, 2000):
        part = rows[begin : begin + 2000]
        best.add(np.arange(begin, begin + len(part)), *ann.encode(part, centre), part)
    assert best.reranked < 0.1 * 30 * 8000
    ids = best.result().column("vec_id").to_numpy().reshape(30, 10)
    assert all(ids[q].tolist() == nearest(rows[q], rows, 10, q) for q in range(30))


def test_an_index_serves_many_searches(spark, monkeypatch):
    """Several stripes and blocks of questions; questions from another table; what is stored is read, not made again."""
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 7)
    r = np.random.default_rng(2)
    m, asked = r.standard_normal((700, 12)), r.standard_normal((25, 12))
    index = ann.Index(frame(spark, m), stripe=150)
    assert index.blocks.select("stripe").distinct().count() >= 5
    assert found(index.search(frame(spark, asked, 10_000), 5)) == {10_000 + i: nearest(q, m, 5) for i, q in enumerate(asked)}
    own = frame(spark, m).filter("id % 50 = 0")
    assert found(index.search(own, 5)) == {i: nearest(m[i], m, 5, i) for i in range(0, 700, 50)}
    plan = index.search(own, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("codes#") and "CartesianProduct" not in index.search(own, 5)._jdf.queryExecution().executedPlan().toString()


def test_lengths_and_no_rows(spark):
    """Each length among its own; a length without rows finds none; repeated questions count once."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [2.0]), (4, [2.0])], VECTORS)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (9, [1.0]), (9, [1.0, 1.0, 1.0])], VECTORS)
    assert found(ann.search(rows, asked, 3)) == {1: [2], 9: [3, 4, 4]}
    assert ann.search(rows.limit(0), asked, 3).count() == 0 and ann.search(rows, asked.limit(0), 3).count() == 0
