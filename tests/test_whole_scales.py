"""Scales come from all clean documents: tables whose first 2,000 clean documents by id are short, and the others long."""

import duckdb
import numpy as np
import pytest

from tessaline.functions import text as T
from tessaline.operators import signals as S
from tessaline.plans import oracle, queries

#: With the scales of the first 2,000, poisoned and long clean documents have equal signals, so that no poisoned one is caught.
EXPECTED = {
    "adaptive_vs_baseline": lambda rows: all(r.asr_base == 0 for r in rows),
    "against_constants": lambda rows: all(r.lower for r in rows),
    "calibration_checkpoint": lambda rows: all(r.doc_length == 400 and r.sent_length == 400 for r in rows),
    "encounter_flags": lambda rows: all(r.flagged for r in rows if r.adv and r.is_poisoned),
    "gate_verdicts": lambda rows: all(r.passed for r in rows),
    "multi_seed_aggregate": lambda rows: all(r.asr_max == 0 for r in rows),
    "smoke_gate_strict": lambda rows: all(r.passed for r in rows),
    "stability": lambda rows: all(r.stable for r in rows),
    "threshold_sweep": lambda rows: all(r.tpr == 1 for r in rows) and any(r.fpr != 0.230769 for r in rows),  # 600 of 2,600
    # queries
}


def words(n):
    """No content words and a period of 10, so that only the length differs from 60 words on."""
    return " ".join(T.STOPWORDS[i % 10] for i in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """2,000 short clean documents, 240 poisoned ones of 60 words among them, then 600 long clean ones.

    Poisoned and long ones have vectors, twelve each along an axis, so that all are as near to the centroid and as coherent.
    """
    folder = tmp_path_factory.mktemp("whole")
    kind = lambda i: "bad" if 200 <= i < 440 else "short" if i < 2240 else "long"
    rows = [(i, words({"bad": 60, "short": 10, "long": 400}[kind(i)])) for i in range(2840)]
    placed = [i for i in range(2840) if kind(i) == "bad"] + list(range(2240, 2768))
    axis = lambda a: [float(j == a) for j in range(64)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    save(rows, "doc_id long, text string", "documents")
    save([(i, 1, int(kind(i) == "bad")) for i, _ in rows], "doc_id long, quality int, toxic int", "labels")
    save([(v, axis(n // 12), 0) for n, v in enumerate(placed)], "vec_id long, embedding array<float>, label int", "embeddings")
    return str(folder)


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", EXPECTED)
def test_scales_of_all_clean_documents(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    made = queries.queries()[name](spark, tables)
    rows, columns = made.collect(), sorted(made.columns)
    assert rows and EXPECTED[name](rows)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(made.select(*columns).collect()) == plain(theirs)


def test_norm_of_raw_is_of_all_clean_documents(spark):
    """Beyond the first 2,000 too; with `first` as before; the defaults without clean documents."""
    texts = [(i, "w, " * (1 + (i * 7919) % 97) + "end of it." * (i % 3), i % 5 == 0) for i in range(2600)]
    texts += [(i, "w " * 500, False) for i in range(2600, 3000)]
    raw = S.raw_features(spark.createDataFrame(texts, "doc_id long, text string, is_poisoned boolean"))
    clean = [r for r in raw.orderBy("doc_id").collect() if not r.is_poisoned]

    def theirs(rows):
        of = [[r.n_words for r in rows], [r.mean_sent_words for r in rows if r.n_sentences], [r.punct_count / max(r.n_words, 1) for r in rows]]
        return [float(np.percentile(x, 90)) for x in of]

    assert list(S.norm_of_raw(raw).first()) == pytest.approx(theirs(clean), abs=1e-12)
    assert list(S.norm_of_raw(raw, 2000).first()) == pytest.approx(theirs(clean[:2000]), abs=1e-12)
    assert S.norm_of_raw(raw).first().doc_length == 500 > S.norm_of_raw(raw, 2000).first().doc_length
    assert list(S.norm_of_raw(raw.filter("is_poisoned")).first()) == list(T.DEFAULT_NORM.values())
