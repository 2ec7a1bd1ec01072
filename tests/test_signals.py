"""Text signals against a plain Python version, and statistics against published figures."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.functions import text as T
from tessaline.operators import signals as S
from tessaline.plans import golden

TEXTS = [
    "", "word", "two words", "a b c", "a b c a b c", "Short. Tiny. No sentence", "Exactly ten. Just eleven!! And one more here.",
    "one two three " * 30, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " w1 w1 w1",
    "The token vault rotates a tokenised credential; access control, oauth — saml [ldap].", "tab\tand\x0bvertical\nline. Next sentence is here.",
    " ".join(f"c{i}" for i in range(19)), " ".join(f"c{i % 7}" for i in range(20)), "No-break space stays inside one word here.",
]


def split(text):
    return [w for w in re.split(T.SPACE, text) if w]


def expected(text):
    words = split(text.lower())
    sents = [s for s in (x.strip(" \t\n\x0b\f\r") for x in re.split("[.!?]+", text)) if len(s) > 10]
    lens = [len(split(s)) for s in sents]
    sample = words[:60]
    grams = [tuple(sample[i : i + 3]) for i in range(len(sample) - 2)]
    content = [w for w in words if w not in T.STOPWORDS]
    n = max(len(words), 1)
    mean = float(np.mean(lens)) if lens else float(n)
    punct = sum(c in T.PUNCTUATION for c in text) / n
    return {
        "sent_unif": 1 / (1 + float(np.std(lens))) if len(lens) >= 2 else 0.5,
        "ttr_signal": 1 - len(set(sample)) / max(len(sample), 1),
        "repeat_rate": sum(grams.count(g) > 1 for g in set(grams)) / len(grams) if len(sample) >= 3 else 0.0,
        "kw_density": min(sum(k in text.lower() for k in T.KEYWORDS) / 10, 1.0),
        "doc_length_signal": 1 - min(n / 300, 1),
        "avg_sent_len_signal": 1 - min(mean / 30, 1),
        "punct_signal": 1 - min(punct / 0.12, 1),
        "content_ttr_signal": 1 - len(set(content)) / len(content) if len(content) >= 20 else 0.5,
    }


def test_text_signals(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = S.signals(S.raw_features(docs)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        for name, value in expected(TEXTS[row.doc_id]).items():
            assert row[name] == pytest.approx(value, abs=1e-12), (name, TEXTS[row.doc_id])


def test_entropy_and_compression(spark):
    docs = spark.createDataFrame([(0, ""), (1, "one"), (2, "a b a b"), (3, "a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.entropy for r in S.word_entropy(docs).collect()} == {0: 0.0, 1: 0.0, 2: 1.0, 3: 2.0}
    assert all(math.copysign(1, r.entropy) == 1 for r in S.word_entropy(docs).collect())
    ratios = {r.doc_id: r.ratio for r in S.compression_ratio(docs).collect()}
    assert ratios[0] == 0.0 and ratios[3] > 1


def test_query_text_and_tag(spark):
    long = "x" * 41
    docs = spark.createDataFrame([(f"short. {long}. y", 0.05), ("z" * 30, 0.0101), ("", 0.1)], "text string, ratio double")
    rows = docs.select(T.query_text(F.col("text")).alias("q"), T.tier_tag(F.col("ratio")).alias("t")).collect()
    assert [r.q for r in rows] == [long + ".", "z" * 30, ""]
    assert [r.t for r in rows] == ["p050", "p010", "p100"]


def test_weights_from_published_ratios(spark):
    weights = S.layer_weights(golden.snrs(spark).filter("tier = 'p050'")).collect()
    by = {(r.layer, r.signal): r for r in weights}
    strength = {s: min(math.log(1 + abs(v[1])), 1.0) for s, v in golden.SNRS.items() if abs(v[1]) > 0.5}
    for layer, left_out in S.LAYERS.items():
        used = {s: v for s, v in strength.items() if s not in left_out}
        assert {s for k, s in by if k == layer} == set(used)
        for s, v in used.items():
            assert by[layer, s].weight == round(v / sum(used.values()), 6)
            assert by[layer, s].flipped == (golden.SNRS[s][1] < 0)
    assert ("L1", "repeat_rate") not in by


def test_gate_is_strict_and_empty_layers_have_no_rows(spark):
    stats = spark.createDataFrame([("a", 0.5), ("b", -0.5)], "signal string, snr double")
    assert S.layer_weights(stats).count() == 0


def test_class_stats_zero_deviation_and_empty_class(spark):
    rows = [(0, False, "s", 1.0), (1, False, "s", 1.0), (2, True, "s", 2.0), (3, True, "t", 1.0)]
    stats = {r.signal: r for r in S.class_stats(spark.createDataFrame(rows, "doc_id long, is_poisoned boolean, signal string, value double")).collect()}
    assert stats["s"].snr == pytest.approx(1e9) and stats["t"].snr is None


def test_norm_config_over_first_clean_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), i % 5 == 0) for i in range(50)], "doc_id long, text string, is_poisoned boolean")
    norm = S.norm_config(docs, first=10).first()
    counts = [i + 1 for i in range(50) if i % 5][:10]
    assert norm.doc_length == pytest.approx(float(np.percentile(counts, 90)))


def test_tamper_flags(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    registry = S.sha_registry(docs.filter("doc_id < 2").withColumn("text", F.when(F.col("doc_id") == 1, "B").otherwise(F.col("text"))))
    assert {r.doc_id: r.tampered for r in S.tamper_flags(docs, registry).collect()} == {0: False, 1: True, 2: True}


def test_split_share_and_stability(spark):
    rows = spark.range(101).select(F.col("id").alias("doc_id"))
    first = {r.doc_id: r.side for r in S.split(rows, 7).collect()}
    assert sum(s == "cal" for s in first.values()) == 60
    assert first == {r.doc_id: r.side for r in S.split(rows.repartition(5), 7).collect()}
    assert first != {r.doc_id: r.side for r in S.split(rows, 8).collect()}
