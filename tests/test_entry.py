"""Queries and SQL agree on the small tables, for the queries outside the training-data subpackage."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessaline.plans import oracle, queries
from tessaline.sources import tables as IO

SF = "/root/testdata/sf0.001"
CHECKED = [
    "text_signals", "text_tokens_sentences", "class_signal_stats", "layer_weights", "layer_weights_gated", "calibrate_tau_strict",
    "smoke_gate_strict", "query_sample_similarity", "quality_gate", "calibrate_tau", "confusion_by_layer", "knn_topk", "overfetch_rerank", "seed_tier_runs",
    "older_gate", "calibration_checkpoint", "calibration_ids", "result_document", "benign_query_sample", "synonym_swap", "variant_cross_product", "framed_documents", "topic_histogram", "cyclic_queries",
    "quality_gate_sample", "registry_versions", "encounter_flags", "threshold_sweep", "midpoint_eval", "quantile_profile", "intra_inter_similarity",
    "word_entropy", "signal_tier_pivot", "gate_verdicts", "adaptive_vs_baseline", "corpus_scan", "retrieved_deviation",
]


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    made = queries.queries()[name](spark, SF)
    columns = sorted(made.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(made.select(*columns).collect()) == plain(theirs)


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_sources_and_sinks(spark, tmp_path):
    docs = IO.labelled(spark, SF)
    IO.write_corpus(docs, str(tmp_path / "c"))
    theirs = {(f"doc_{r.doc_id}", r.text, r.is_poisoned) for r in docs.collect()}
    assert {(r.id, r.text, r.is_poisoned) for r in IO.read_corpus(spark, str(tmp_path / "c")).collect()} == theirs
    assert IO.read_results(spark, str(tmp_path / "none")).count() == 0
    assert "Error" in IO.markdown_summary(spark.createDataFrame([(None, 1.0)], "a string, b double"))


def test_encoded_queries(spark):
    """One pass over all queries gives unit vectors, the same as for a query alone."""
    from tessaline.operators import encode

    found = queries.encoded_queries(spark, SF).collect()
    lengths = {}
    for r in found:
        lengths[r.id] = lengths.get(r.id, 0) + r.x**2
    assert lengths and all(abs(v - 1) < 1e-4 for v in lengths.values())
    one = queries.cyclic_queries(spark, SF).filter("query_id = 3").first()
    alone = encode.HashedWords(256)([one.q])[0]
    assert {i: round(x, 6) for i, x in enumerate(alone) if x} == {r.i: r.x for r in found if r.id == "a3"}


def test_stream_scoring(spark, tmp_path):
    """A stream scored with the stored calibration has the scores of the corpus it was made from."""
    from tessaline.streaming.scoring import frozen, score_stream

    parts = frozen(queries._checkpoint(spark, SF)[0])
    docs = IO.labelled(spark, SF).drop("is_poisoned").join(queries._vector_signals(spark, SF), "doc_id", "left")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, *parts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    made = {(r.doc_id, r.layer): r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    theirs = {(r.doc_id, r.layer): r.score for r in queries.composite_scores(spark, SF).collect()}
    assert made.keys() == theirs.keys() and made
    assert all(abs(v - theirs[k]) < 1e-6 for k, v in made.items())
