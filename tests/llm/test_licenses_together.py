"""License notices that share a window, against the query's SQL."""

import random

import duckdb
from tessaline.llm import licenses
from tessaline.llm.registry import OP7_SQL


def test_notices_together(spark):
    rng, names = random.Random(3), sorted(licenses.TEMPLATES)
    t = licenses.TEMPLATES
    texts = [f"{t['MIT-grant']} {t['CC-BY-NC-4.0']}", f"{t['BSD']} {t['MIT']} {t['GPL-3.0']}", f"{t['Apache-2.0']} {t['MIT']} {t['MIT-grant']}"]
    for _ in range(60):
        parts = [t[n] for n in rng.sample(names, rng.randint(2, 6))]  # whole texts and headers too
        texts.append(" ".join(f"{p} {' '.join(['word'] * rng.choice([0, 0, 3, 30]))}" for p in parts))
    for _ in range(30):  # a long notice in two pieces
        words = t[rng.choice(["BSD", "MIT-grant", "MIT-text", "Apache-2.0-header"])].split()
        cut = rng.randint(8, len(words) - 8)
        texts.append(" ".join([*["word"] * rng.randint(0, 70), *words[: cut + 4], *["word"] * rng.randint(1, 60), *words[cut:]]))
    rows = list(enumerate(texts))
    found = licenses.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {(r.doc_id, r.license) for r in found} >= {(0, "CC-BY-NC-4.0"), (1, "MIT"), (2, "MIT")}
    assert sorted(tuple(r) for r in found) == sorted(con.sql(OP7_SQL).fetchall())


def test_many_shingles_are_joined(spark):
    """Beyond the bound on what is part of the plan, the same rows are found by joins."""
    t = licenses.TEMPLATES
    rows = [(i, f"some words {t[n]} and more") for i, n in enumerate(sorted(t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = licenses.scan(docs), licenses.scan(docs, plan_shingles=10)
    found = sorted(map(tuple, one.collect()))
    assert found == sorted(map(tuple, other.collect()))
    assert {(r[0], r[2]) for r in found} and len({r[2] for r in found}) == len(t)
