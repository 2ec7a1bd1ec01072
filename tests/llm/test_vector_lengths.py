"""Vectors of each length meet those of the same length."""

from tessaline.llm import ann


def test_each_length_is_searched(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(8)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(4)] + [(200, [5.0])]
    found = ann.op9(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    near = {q: [r.vec_id for r in found if r.query_id == q] for q in (0, 100, 200)}
    assert near == {0: [1, 2, 3, 4, 5, 6, 7], 100: [101, 102, 103], 200: []}
