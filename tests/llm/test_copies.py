"""The pipeline's copies are those of five-word shingle similarity 0.8 or more, no others."""

import random

import corpus_pipeline
from tessaline.llm import copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def share(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def kept(spark, texts):
    rows = [(i, t, None, None, len(t)) for i, t in texts.items()]
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def edited(rng, text, changes):
    words = text.split()
    for i in range(changes):
        words[(i + 1) * len(words) // (changes + 1)] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_all_copies_of_similarity_are_found(spark):
    rng, texts = random.Random(5), {}
    for n in range(0, 400, 2):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        texts |= {n: base, n + 1: edited(rng, base, 4)}
    pairs = [(n, n + 1) for n in range(0, 400, 2)]
    assert all(0.8 <= share(texts[a], texts[b]) < 0.9 for a, b in pairs)
    prints = {i: simhash.simhash_bytes(t.encode(), 5) for i, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 6 for a, b in pairs) > 50
    assert kept(spark, texts) == set(range(0, 400, 2))


def test_members_meet_beyond_the_hub(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    far = [edited(random.Random(i), base, 5) for i in range(6)]  # 25 of 196 shingles apart from the base
    texts = dict(enumerate([t for f in far for t in (f, edited(rng, f, 2))]))
    close = [(a, b) for a in texts for b in texts if a < b and share(texts[a], texts[b]) >= 0.8]
    stay = set(texts)
    for a, b in sorted(close):
        stay.discard(b)
    assert close and kept(spark, texts) == stay


def test_texts_under_the_similarity_stay(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id IN (155, 192)").collect()}
    prints = [simhash.simhash_bytes(t.encode(), 5) for t in texts.values()]
    assert (prints[0] ^ prints[1]).bit_count() <= 6 and share(*texts.values()) < 0.8
    assert kept(spark, texts) == {155, 192}


def test_fingerprints_propose_copies(spark):
    """SimHash alone links the copies within its bits, checked by similarity; MinHash adds the others."""
    rng, texts = random.Random(8), {}
    for n in range(0, 120, 2):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        texts |= {n: base, n + 1: edited(rng, base, 1 + n % 4)}
    prints = {i: simhash.simhash_bytes(t.encode(), 5) for i, t in texts.items()}
    close = {n + 1 for n in range(0, 120, 2) if (prints[n] ^ prints[n + 1]).bit_count() <= copies.BITS}
    rows = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in texts.items()], SCHEMA)
    assert 5 < len(close) < 60
    assert {r.doc_id for r in copies.keep_one(rows, wider=False).collect()} == set(texts) - close
    assert kept(spark, texts) == set(range(0, 120, 2))
