"""Phases that are kept, the hash registry and runs that go on where they stopped."""

import hashlib

from pyspark.sql import functions as F

from tessaline.operators.registry import HashRegistry
from tessaline.sources import shared
from tessaline.sources.phases import Phases, exists, fingerprint


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_a_finished_phase_is_not_made_again(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "in"))

    for phases in (Phases(spark, str(tmp_path / "p")), Phases(spark, str(tmp_path / "p"))):
        assert not phases.done("a", [str(tmp_path / "in")], {"x": 2})
        assert phases.get("a", [str(tmp_path / "in")], {"x": 1}, make).count() == 5
    assert len(made) == 1
    phases.get("a", [str(tmp_path / "in")], {"x": 2}, make)  # other settings
    phases.get("b", [str(tmp_path / "in")], {"x": 1}, make)  # another name
    assert len(made) == 3 and {r.name for r in phases.manifest().collect()} == {"a", "b"}
    phases.reset("a")
    assert {r.name for r in phases.manifest().collect()} == {"b"}
    phases.get("a", [str(tmp_path / "in")], {"x": 1}, make)
    spark.range(9).write.mode("append").parquet(str(tmp_path / "in"))
    assert phases.get("a", [str(tmp_path / "in")], {"x": 1}, make).count() == 14  # the input is another one
    assert len(made) == 5
    phases.reset()
    assert phases.manifest().count() == 0


def test_a_phase_that_fails_is_not_taken_for_finished(spark, tmp_path):
    phases = Phases(spark, str(tmp_path / "p"))
    bad = lambda: spark.range(3).select(F.raise_error("no").cast("int").alias("x"))
    try:
        phases.get("a", [], {}, bad)
        raise AssertionError("no error")
    except Exception as e:
        assert "AssertionError" not in type(e).__name__
    assert not phases.done("a", [], {}) and phases.get("a", [], {}, lambda: spark.range(2)).count() == 2


def test_fingerprints(spark, tmp_path):
    path = str(tmp_path / "t")
    before = fingerprint(spark, [path])
    spark.range(3).write.parquet(path)
    after = fingerprint(spark, [path])
    assert before != after == fingerprint(spark, [path])


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    """A second call starts no job for a finished run; a reset names runs."""
    from tessaline.plans import queries

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.tessaline.phases", str(tmp_path / "kept"))
    tracker, before = spark.sparkContext.statusTracker(), queries.TIERS
    queries.TIERS = {"p100": 0.10}
    try:
        first = sorted(map(tuple, queries._run(spark, sf, "p100", 42).collect()))
        spark.sparkContext.setJobGroup("again", "again")
        again = queries._run(spark, sf, "p100", 42)
        started = len(tracker.getJobIdsForGroup("again"))
        assert sorted(map(tuple, again.collect())) == first and first
        assert started <= 1  # of reading the schema
        Phases(spark).reset("run,tier=p100,seed=42")
        names = {r.name for r in Phases(spark).manifest().collect()}
        assert "run,tier=p100,seed=42" not in names and "scores" in names
        assert sorted(map(tuple, queries._run(spark, sf, "p100", 42).collect())) == first
    finally:
        queries.TIERS = before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.tessaline.phases")


def test_registry(spark, tmp_path):
    registry = HashRegistry(spark, str(tmp_path / "r"))
    assert registry.versions() == [] and registry.current().count() == 0
    assert registry.register(docs(spark, {1: "a", 2: "b", 3: None, None: "x"})) == 1
    assert registry.register(docs(spark, {2: "B", 4: "d", 1: "a"})) == 2
    assert spark.read.parquet(str(tmp_path / "r" / "version=2")).count() == 2  # what changed, alone
    state = {r.doc_id: (r.sha, r.version) for r in registry.current().collect()}
    assert state == {1: (sha("a"), 1), 2: (sha("B"), 2), 3: (sha(""), 1), 4: (sha("d"), 2)}
    assert {r.doc_id: r.sha for r in registry.current(1).collect()} == {1: sha("a"), 2: sha("b"), 3: sha("")}
    flags = {r.doc_id: r.tampered for r in registry.flags(docs(spark, {1: "a", 2: "b", 3: "", 5: "e", None: "x"})).collect()}
    assert flags == {1: False, 2: True, 3: False, 5: True, None: True}
    assert registry.register(docs(spark, {1: "a"}), complete=True) == 3
    assert {r.doc_id for r in registry.current().collect()} == {1}
    registry.register(docs(spark, {2: "B"}))
    assert {r.doc_id for r in registry.current().collect()} == {1, 2}


def test_stored_tables_can_be_released(spark):
    shared.release(spark)
    rows = shared.stored(spark.range(3))
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert rows.count() == 3 and exists(spark, path)
    assert shared.release(spark) == 1 and not exists(spark, path) and shared.release(spark) == 0
