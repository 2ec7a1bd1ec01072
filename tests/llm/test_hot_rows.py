"""Rows without an id, ids that repeat, very large vectors and very long labelled texts."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessaline.llm import ann, fingerprint, packing, toxicity


def test_rows_without_an_id_are_dealt_over_all_tasks(spark):
    """4,000 pieces, a third of them alike, none with an id."""
    rows = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 900 + 1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"),
    )
    packed = packing.pack(rows, task_sequences=40)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 40)).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * 4000 / len(sizes)
    places = {}
    for r in packed.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(len(p) for p in places.values()) == 4000
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_packing_beside_columns_of_the_same_names(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5, 9, "x", "y", "z")], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id string, offset string, _at string")
    assert packing.pack(rows).columns == [*rows.columns, "sequence_id_", "offset_"]


def test_fingerprints_of_rows_without_an_id(spark):
    """A hot id is cut into parts, and each text still meets its successor."""
    rows = [(None if i % 3 else i, f"text {i} " * 40) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = fingerprint.with_successors(frame, part_bytes=20_000)
    sizes = [r["count"] for r in parts.filter("NOT last").groupBy("part").count().collect()]
    assert max(sizes) < 900 / 6 and sum(sizes) == 900
    assert parts.filter("last").count() <= 2 * len(sizes)
    made = sorted(r.edited_sha256 for r in fingerprint.op3(frame).collect())
    hashed = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashed[r]))
    whole = []
    for (_, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        whole.append(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())
    assert made == sorted(whole)
    many = [(r.edited_sha256) for r in fingerprint.compare_edited(frame).collect()]
    assert sorted(many) == made


def test_vectors_whose_squares_overflow(spark):
    """Finite vectors take part, whatever their size."""
    r = np.random.default_rng(3)
    m = np.concatenate([r.standard_normal((40, 4)), r.standard_normal((40, 4)) * 1e160, r.standard_normal((20, 4)) * 1e-300])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    made = {}
    for x in ann.search(rows, rows.filter("id % 10 = 0"), k=10).collect():
        made.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q in range(0, 100, 10):
        with np.errstate(over="ignore"):
            step = m - m[q]
            plain = np.sqrt((step * step).sum(axis=1))
        far = np.where(np.isfinite(plain), plain, 1e160 * np.sqrt(((step / 1e160) ** 2).sum(axis=1)))
        far[q] = np.inf
        got = [s for _, _, s in sorted(made[q])]
        assert len(got) == 10 and np.allclose(got, np.sort(far)[:10], rtol=1e-9)
    alone = spark.createDataFrame([(0, [1e160] * 3), (1, [-1e160] * 3), (2, [1.7e308] * 3), (3, [-1.7e308] * 3)], "id long, v array<double>")
    assert {(x.query_id, x.vec_id) for x in ann.search(alone, alone, k=3).collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}


def plain_noisy_or(model, text):
    """1 - the product of (1 - p) over sentences, with p from the words one by one."""
    left, any_sentence = 1.0, False
    for sentence in toxicity.occurrences(text):
        any_sentence = True
        z = model.bias + sum(model.weights.get(f, 0.0) for f in sentence)
        left *= 1 - 1 / (1 + np.exp(-z))
    return 1 - left if any_sentence else 0.0


def test_noisy_or_against_a_plain_version():
    model = toxicity.Model(-2.0, {"bad": 3.0, "^wor": 1.0, "words": 0.5, "good": -1.0})
    scorer = toxicity.Scorer(model)
    for text in ("", "Bad.", "bad words. Good words!\nno stop", "worse worst bad? bad bad.", "a b c", " \n ", "Words, words: good... bad"):
        assert np.isclose(scorer.score(text), plain_noisy_or(model, text))


def test_descent_ends_where_the_slope_is_flat():
    """The loss that `optimise` lowers, worked out plainly: its numeric gradient at the end is close to zero, and lower than nearby."""
    r = np.random.default_rng(2)
    size, docs = 4, 60
    doc = np.repeat(np.arange(docs), 3)
    row, col = np.arange(len(doc)).repeat(2), r.integers(0, size, 2 * len(doc))
    toxic = np.bincount(doc[row], col == 0, minlength=docs) > r.integers(0, 3, docs)

    def loss(x):
        z = x[-1] + np.bincount(row, x[:-1][col], minlength=len(doc))
        total = np.bincount(doc, np.log1p(np.exp(z)), minlength=docs)
        weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
        return (weight * np.where(toxic, -np.log(-np.expm1(-total)), total)).sum() + 1e-5 * (x[:-1] ** 2).sum()

    w, b = toxicity.optimise(size, doc, row, col, toxic, rounds=3000)
    x = np.append(w, b)
    gradient = np.array([(loss(x + 1e-5 * e) - loss(x - 1e-5 * e)) / 2e-5 for e in np.eye(size + 1)])
    assert np.abs(gradient).max() < 2e-3
    assert all(loss(x) <= loss(x + 0.5 * s * e) + 1e-9 for e in np.eye(size + 1) for s in (-1, 1))


def test_one_long_labelled_text_leaves_the_weights(spark):
    """Whatever its place in the order, a text of 25 million characters doesn't end the sample, nor do repeated ids."""
    texts = [(i, ("you idiot and fool. " if i % 4 == 0 else "a kind and calm day. ") * 3 + f"word{i % 9} here.") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(601)], "doc_id long, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    long = spark.range(1).select(F.lit(600).cast("long").alias("doc_id"), F.repeat(F.lit("a kind day. "), 2_100_000).alias("text"))
    plain, with_long = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(long), labels)
    assert plain.weights and plain.weights.keys() == with_long.weights.keys()
    assert all(abs(plain.weights[k] - with_long.weights[k]) < 0.05 for k in plain.weights)
    again = toxicity.fit(docs.unionByName(docs.filter("doc_id < 9").withColumn("text", F.concat("text", F.lit(" more. ")))), labels)
    assert again.weights.keys() == plain.weights.keys()


def test_room_of_the_sample():
    from pyspark.sql import Row

    facts = [Row(doc_id=i, toxic=i % 2, chars=10 if i else 95, print=i, h=i / 10) for i in range(10)]
    used = toxicity._room(facts, 100, 50)
    assert {r.doc_id for r in used} == {2, 4, 6, 8, 1, 3, 5, 7, 9}  # the long one last, where it doesn't fit
    assert [r.doc_id for r in toxicity._room(facts[:1], 100, 50)] == [0] and toxicity._room(facts[:1], 90, 50) == []
