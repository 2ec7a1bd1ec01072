"""Order statistics, quantiles, first rows of an order and sweeps against numpy and plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.operators import detection as D
from tessaline.operators import selection as X
from tessaline.operators import signals as S


@pytest.mark.parametrize("buckets", [4, 65_536])
def test_order_statistics(spark, monkeypatch, buckets):
    """Ties, signs, zeros, very small and large values, infinities, NaN, nulls, and null groups."""
    monkeypatch.setattr(X, "BUCKETS", buckets)
    r = random.Random(1)
    special = [0.0, -0.0, 1e-320, -1e-320, 1e300, -1e300, float("inf"), float("-inf"), 1.0, 1.0, 2.0, 0.5, 0.49999999999999994]
    groups = {
        "a": [r.random() for _ in range(500)], "b": [r.choice([0.25, 0.5, 0.75]) for _ in range(300)], None: special * 3,
        "c": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(400)], "d": [7.0], "e": [float("nan"), 1.0, float("nan")],
    }
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [("f", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ranks = {f"r{i}": F.lit(i) for i in (0, 1, 5, 38, 299)} | {"last": F.col("n") - 1, "over": F.col("n"), "mid": F.floor(F.col("n") / 2)}
    made = {(x.g, x.cut): (x.n, x.value) for x in X.order_statistics(frame, ["g"], "v", ranks).collect()}
    want = {}
    for g, values in groups.items():
        ordered = sorted(values, key=lambda v: (math.isnan(v), v))
        for cut, i in {**{f"r{i}": i for i in (0, 1, 5, 38, 299)}, "last": len(values) - 1, "mid": len(values) // 2}.items():
            if i < len(values):
                want[g, cut] = (len(values), ordered[i])
    assert {k: str((n, v + 0.0)) for k, (n, v) in made.items()} == {k: str((n, v + 0.0)) for k, (n, v) in want.items()}


def test_quantiles(spark):
    r = np.random.default_rng(2)
    values = {"a": r.standard_normal(777), "b": np.round(r.random(100), 1), "c": np.array([3.0])}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    made = {(x.g, x.share): x.value for x in X.quantiles(frame, ["g"], "v", shares).collect()}
    assert made == {(g, p): pytest.approx(float(np.quantile(vs, p))) for g, vs in values.items() for p in shares}
    one = X.quantile_columns(frame.filter("g = 'a'"), [], "v", [0.5]).collect()
    assert [x.p50 for x in one] == [pytest.approx(float(np.median(values["a"])))]


@pytest.mark.parametrize("k", [0, 1, 7, 60, 100, 500])
def test_first_in_hash_order(spark, k):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    order = sorted(range(100), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert {x.doc_id for x in S.sample(rows, k, 5).collect()} == set(order[:k])


def test_first_in_hash_order_with_repeated_hashes(spark):
    """Rows of one hash are told apart by their id; equal rows stay or go together."""
    rows = spark.range(50).select(F.col("id"), F.lit("abcdef01").alias("h"))
    taken = X.take_first(rows, F.col("h"), "id", F.lit(20), "t")
    assert {x.id for x in taken.filter("t").collect()} == set(range(20))
    assert X.take_first(rows.limit(0), F.col("h"), "id", F.lit(20), "t").count() == 0


def test_no_task_ranks_all_rows(spark):
    """No sort or window over the rows themselves: windows see counts, or rows of one prefix."""
    plan = S.split(spark.range(100).select(F.col("id").alias("doc_id")), 1)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window " in line and "row_number" in line:
            assert "_r" in line
    assert "Sort [" not in plan


def test_sweeps(spark):
    r = random.Random(3)
    rows = [(layer, r.random() < 0.3, round(r.random(), 2)) for layer in ("L1", "L2") for _ in range(300)] + [("L3", True, 0.5)] * 3
    frame = spark.createDataFrame(rows, "layer string, is_poisoned boolean, score double")
    made = {(x.layer, x.step): x for x in D.threshold_sweep(frame, 15, ["layer"]).collect()}
    for layer in ("L1", "L2", "L3"):
        scores = [(b, s) for name, b, s in rows if name == layer]
        lo, hi = min(s for _, s in scores), max(s for _, s in scores)
        rated = []
        for step in range(21):
            t = round(lo + step * (hi - lo) / 20, 9)
            share = lambda bad: [s > t for b, s in scores if b == bad]  # noqa: B023, E731
            tpr, fpr = (sum(x) / len(x) if x else None for x in (share(True), share(False)))
            rated.append((t, None if None in (tpr, fpr) else round(tpr - fpr, 9)))
        for step in range(15):
            t = made[layer, step].threshold
            assert t == pytest.approx(lo + step * (hi - lo) / 15, abs=1e-9)
            over = [s > t for b, s in scores if b]
            assert made[layer, step].tpr == pytest.approx(sum(over) / len(over))
        best = [x for x in D.youden_best(frame, 20, ["layer"]).collect() if x.layer == layer]
        if layer != "L3":
            most = max(y for _, y in rated)
            assert (best[0].threshold, best[0].youden) == (pytest.approx(next(t for t, y in rated if y == most)), pytest.approx(most))


def test_grid_counts_each_record_once(spark):
    r = random.Random(4)
    rows = [(q, q % 3 == 0, r.random() < 0.4, round(r.uniform(0.2, 0.7), 3)) for q in range(60) for _ in range(5)]
    frame = spark.createDataFrame(rows, "query_id long, adv boolean, is_poisoned boolean, score double")
    settings = [(0, 1.0, 0.4, None), (1, None, None, 0.5), (2, 0.5, 0.0, 0.6), (3, 1.5, 0.45, 0.45), (4, None, None, None)]
    grid = spark.createDataFrame(settings, "config int, n_std double, min_abs double, abs_high double")
    made = {x.config: x for x in D.grid_evaluate(frame, grid).collect()}
    for config, n, low, high in settings:
        hits = []
        for q, adv, bad, score in rows:
            mine = [s for q2, _, _, s in rows if q2 == q]
            mu, sd = np.mean(mine), np.std(mine)
            hits.append((adv, bad, (n is not None and score > round(mu + n * sd, 9) and score > low) or (high is not None and score > high)))
        asr = 100 * sum(a and b and not h for a, b, h in hits) / sum(a and b for a, b, _ in hits)
        fpr = 100 * sum(not a and not b and h for a, b, h in hits) / sum(not b for _, b, _ in hits)
        assert (made[config].asr, made[config].doc_fpr) == (pytest.approx(asr), pytest.approx(fpr))
    plan = D.grid_evaluate(frame, grid)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("Join") :]
    assert joins.index("Aggregate") < joins.index("query_id")  # the product is of settings and cells


def test_entropy_of_words(spark):
    texts = ["", "one", "a b A B", "a b c d", "x " * 1000, " ".join(f"w{i % 7}" for i in range(50)), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in S.word_entropy(rows.fillna("")).collect():
        words = (texts[x.doc_id] or "").lower().split()
        counts = [words.count(w) for w in set(words)]
        assert x.entropy == pytest.approx(-sum(c / len(words) * math.log2(c / len(words)) for c in counts) if words else 0.0, abs=1e-9)
