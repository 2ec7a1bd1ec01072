"""Thresholds, confusion counts, neighbours, reports and generation on small cases."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessaline.operators import detection as D
from tessaline.operators import encode as E
from tessaline.operators import generate as G
from tessaline.operators import neighbours as N
from tessaline.operators import reports as R
from tessaline.plans import golden
from tessaline.sources import tables as IO

SCORES = "doc_id long, is_poisoned boolean, layer string, score double"


def test_tau_is_the_order_statistic(spark):
    rng = np.random.default_rng(1)
    for n, target in ((50, 0.05), (200, 0.0069), (30, 0.5)):
        values = np.round(rng.random(n), 2)
        rows = [(i, False, "L1", float(v)) for i, v in enumerate(values)] + [(1000, True, "L1", 5.0)]
        tau = D.calibrate(spark.createDataFrame(rows, SCORES), target).first().tau
        assert tau == sorted(values, reverse=True)[int(target * n)]
        assert (values > tau).mean() <= target


def test_too_few_clean_rows_give_no_tau(spark):
    rows = [(i, False, "L1", 0.5) for i in range(9)]
    assert D.calibrate(spark.createDataFrame(rows, SCORES)).count() == 0


def test_confusion_counts(spark):
    names = "query_id long, adv boolean, doc_id long, is_poisoned boolean, in_calibration boolean, tampered boolean, layer string, score double"
    rows = [
        (1, False, 1, False, True, True, "L1", 0.9),  # excluded, though tampered
        (2, False, 2, False, False, False, "L1", 0.9),  # false positive
        (2, False, 3, False, False, False, "L1", 0.5),  # at the threshold: not flagged
        (2, False, 4, True, False, False, "L1", 0.9),  # poison met by a benign query: a catch only
        (3, True, 4, True, True, False, "L1", 0.1),  # attack on a calibration document: success
        (3, True, 5, True, False, True, "L1", 0.1),  # caught by its hash
        (3, True, 6, False, False, False, "L1", 0.9),  # clean document of an attack: counts nowhere
    ]
    taus = spark.createDataFrame([("L1", 0.5)], "layer string, tau double")
    row = D.confusion(D.flags(spark.createDataFrame(rows, names), taus), F.lit(4)).first()
    assert (row.attempts, row.successes, row.clean_seen, row.fp_docs) == (2, 1, 2, 1)
    assert (row.hash_catches, row.score_catches) == (1, 3)
    assert (row.asr, row.doc_fpr, row.query_fpr) == (50.0, 50.0, 25.0)


def test_relative_flags_with_equal_scores(spark):
    rows = [(1, i, 0.5) for i in range(5)] + [(2, i, s) for i, s in enumerate([0.1, 0.1, 0.1, 0.1, 0.9])]
    flagged = D.relative_flags(spark.createDataFrame(rows, "query_id long, id long, score double")).filter("flagged").collect()
    assert [(r.query_id, r.id) for r in flagged] == [(2, 4)]


def test_top_k_against_numpy_with_ties(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[10:15] = m[10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    found = N.top_k(rows, rows, 5).collect()
    sims = np.round(m @ m.T, 9)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)] == order
    coh = {r.query_id: r.cluster_coh for r in N.coherence(N.top_k(rows, rows, 5), rows).collect()}
    for i in range(60):
        near = m[[r.id for r in found if r.query_id == i]]
        g = near @ near.T
        assert coh[i] == pytest.approx((g.sum() - np.trace(g)) / 20)


def test_coherence_of_one_neighbour_is_the_default(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>")
    assert {r.cluster_coh for r in N.coherence(N.top_k(rows, rows, 5), rows).collect()} == {0.5}


def test_variants_are_distinct_and_bounded(spark):
    bases = G.templates(spark)
    made = G.variants(bases)
    assert made.count() == made.select("text").distinct().count()
    assert [(r["var"], r.base) for r in G.variants(bases, count=5).collect()] == [(0, i) for i in range(5)]
    for wrong in ({"count": 10**6}, {"numbers": [1920]}):
        with pytest.raises(ValueError):
            G.variants(bases, **wrong)


def test_chained_and_first_only_replacement(spark):
    df = spark.createDataFrame([("each spring; each autumn; should, should",)], "t string")
    chained = df.select(G.replace_all(F.col("t"), G.TIMES[2])).first()[0]
    assert chained == "at harvest time; at harvest time; should, should"
    assert df.select(G.replace_once(F.col("t"), "should", "must")).first()[0].endswith("must, should")


def test_injection_and_perturbations(spark):
    docs = spark.createDataFrame([(i, "word " * 40 + f"n{i}") for i in range(20)], "doc_id long, text string")
    rows = {r.doc_id: r for r in G.inject(docs, ["p0", "p1"], 0.15).collect()}
    assert [rows[i].text for i in range(3)] == ["p0", "p1", "p0"] and not rows[3].is_poisoned
    dropped = {r.doc_id: r.text.split() for r in G.drop_tokens(docs).collect()}
    assert all(25 <= len(w) <= 41 and w[-1] == f"n{i}" for i, w in dropped.items())
    assert any(len(w) < 41 for w in dropped.values())
    few = spark.createDataFrame([(0, "A garden."), (1, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in G.shuffle_sentences(few).collect()} == {0: "A garden.", 1: ""}


def test_published_aggregates(spark):
    rows = {(r.layer, r.tier): r for r in R.multi_seed(golden.results(spark)).collect()}
    assert round(rows["L3", "p050"].asr_mean, 2) == 16.27 and round(rows["L3", "p050"].asr_std, 2) == 2.31
    assert round(rows["L1", "p100"].doc_fpr_mean, 3) == 0.953 and round(rows["L1", "p100"].doc_fpr_std_pop, 3) == 0.276
    assert all(r.passed for r in R.gate_verdicts(golden.results(spark)).collect())


def test_perturbation_ends_and_keeps_ids(spark):
    docs = G.variants(G.templates(spark), count=30).select((F.col("var") * 10 + F.col("base")).cast("long").alias("doc_id"), "text")
    out = E.perturb_until_apart(docs, rounds=1)
    assert out.count() == 30 and out.agg(F.max("rounds")).first()[0] == 1


def test_encoder_sees_each_text_once(spark, tmp_path):
    """Repeated texts, nulls and empty texts; a second call encodes only what is new."""
    texts = {0: "The cat", 1: "the CAT sat", 2: "The cat", 3: None, 4: "", 5: "x " * 50}
    seen = spark.sparkContext.accumulator(0)

    class Counting(E.HashedWords):
        def __call__(self, given):
            seen.add(len(given))
            return super().__call__(given)

    store = str(tmp_path / "store")
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    made = {r.id: r.v for r in E.encode_with(docs, Counting(16), store, batch=2).collect()}
    plain = E.HashedWords(16)([t or "" for t in texts.values()])
    assert len(made) == 6 and all(np.allclose(made[i], plain[i]) for i in texts)
    assert seen.value == 4
    more = docs.unionByName(spark.createDataFrame([(6, "new"), (7, "The cat")], "id long, text string"))
    assert E.encode_with(more, Counting(16), store).count() == 8 and seen.value == 5
    assert E.encode_with(docs.limit(0), Counting(16)).count() == 0


def test_calibration_ids_are_a_sorted_set(spark, tmp_path):
    """The files, in the order of their names, hold ascending ids without repeats."""
    ids = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("doc_id"))
    model = spark.createDataFrame([("L1",)], "layer string")
    IO.write_checkpoint(model, ids, str(tmp_path / "c"))
    files = sorted((tmp_path / "c" / "ids").glob("part-*.parquet"))
    held = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert held == list(range(1000))


def test_corpus_scan(spark):
    rows = spark.createDataFrame([(i, " " + "x" * (295 + i) + "\n") for i in range(20)], "doc_id long, text string")
    assert sorted(r.doc_id for r in IO.corpus_scan(rows, 5).collect()) == [6, 7, 8, 9, 10]


def test_runs_broadcast_no_table_that_grows(spark):
    """Encounters are joined without sending scores, queries or flags to the driver."""
    from tessaline.plans.queries import Evaluation

    ids = range(60)
    rows = spark.createDataFrame([(i, i % 10 == 0) for i in ids], "id long, is_poisoned boolean")
    met = spark.createDataFrame([(i, (i + j) % 60) for i in ids for j in (1, 2)], "query_id long, doc_id long")
    tampered = spark.createDataFrame([(i, False) for i in ids], "doc_id long, tampered boolean")
    scores = spark.createDataFrame([(i, i % 10 == 0, "L1", i / 60) for i in ids], SCORES)
    made = Evaluation(scores, rows, met, tampered)
    plan = made.encounters._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and made.encounters.count() > 0


def test_compression_ratio(spark):
    import zlib

    from tessaline.operators import signals as S

    texts = {1: "", 2: "a" * 5000, 3: "ä b\n", 4: None}
    found = {r.doc_id: r.ratio for r in S.compression_ratio(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {i: len(zlib.compress(t.encode())) / len(t.encode()) if t else 0.0 for i, t in texts.items()}
