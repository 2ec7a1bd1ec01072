"""Merkle manifests against a plain version."""

import hashlib
import zlib

import pytest

from tessaline.llm import merkle

LOWER = str.maketrans(merkle._UPPER, merkle._LOWER)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(hashes, fanout=16):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i : i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def proof(found, i, fanout=16):
    out = []
    for level in found[:-1]:
        begin = i // fanout * fanout
        out.append((level[begin:i], level[i + 1 : begin + fanout]))
        i //= fanout
    return out


def plain(rows):
    """op11's rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {name: levels([leaf(r) for r in trees[name]]) for name in names}
    top = levels([built[name][-1][0] for name in names])
    out = []
    for j, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            path = proof(built[name], i) + proof(top, j)
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = (*row[:4], row[4].translate(LOWER))
            folded = leaf(now)
            for left, right in path:
                folded = H(*left, folded, *right)
            siblings = H(*[h for left, right in path for h in (*left, *right)])
            out.append((row[0], leaf(row), built[name][-1][0], top[-1][0], siblings, folded, folded == top[-1][0]))
    return out


def same(made, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain(rows), key=key)


def test_edges(spark):
    """Nulls in every column, an empty and a very long text, repeated rows and ids, other columns."""
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É☃") for i in range(40)]
    rows += [
        (None, None, None, None, None), (None, None, None, None, None), (None, "s1", "en", 1, "No id"), (41, "", "en", 0, ""),
        (42, None, "de", -5, None), (7, "s1", "en", 7, "Another text of an id"), (7, "s1", "en", 7, "Another text of an id"),
        (43, "only", None, 10**12, "LONG " * 200_000), (44, "\U0001d54f", "fr", 1, "Last by bytes"), (45, "￿", "fr", 1, "Before it"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", tree string, i int")
    same(merkle.op11(frame), rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_runs_of_every_size(spark, n):
    """Full runs, runs of one, and trees that are a single leaf; one source with nearly all rows, many with one."""
    rows = [(i, "hot", "en", 1, f"Text {i}") for i in range(n)] + [(1000 + i, f"s{i:02}", "en", 1, "A") for i in range(n % 40)]
    same(merkle.op11(spark.createDataFrame(rows, SCHEMA)), rows)


def test_no_rows(spark):
    assert merkle.op11(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_change_anywhere_is_found(spark):
    """Each changed leaf, and each changed sibling, leads to another root."""
    rows = [(i, "ab"[i % 2], "en", 1, f"T{i}") for i in range(70)]
    frame = spark.createDataFrame(rows, SCHEMA)
    made = merkle.manifest(frame.selectExpr("source AS tree", "doc_id", "sha2(text, 256) AS h"), ["doc_id"], fanout=4)
    found = made.proofs(frame).collect()
    assert len(found) == 70
    for r in found:
        steps = [(s.left, s.right) for s in r.path]

        def folded(h, steps):
            for left, right in steps:
                h = H(left, h, right)
            return h

        assert folded(r.h, steps) == made.root != folded(H("other"), steps)
        k = next(k for k, s in enumerate(steps) if s[0] or s[1])
        bent = [(a, b) if i != k else (a[::-1], b[::-1]) for i, (a, b) in enumerate(steps)]
        assert folded(r.h, bent) != made.root


def test_a_fanout_must_shrink(spark):
    with pytest.raises(ValueError):
        merkle.Forest(spark.createDataFrame([], "tree string, i long, n long, h string"), 1)
