"""Homomorphic multiset fingerprints of documents, summed from hashed paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import (
    SLICE_BYTES,
    bytes_estimate,
    free_name,
    hash_words,
    id_back,
    id_key,
    join_hash,
    mix,
    words_of,
)

#: Lanes modulo 2**64 that tell texts apart, and lanes modulo 2**16 that tell how alike they are.
EXACT, ALIKE = 16, 256
SHINGLE = 3
_NUMBERS = np.arange(1, EXACT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Prints:
    """Fingerprints of several texts: `exact` (n by EXACT) and `alike` (n by ALIKE).

    A paragraph is a line. Its wide vector has two parts, both fixed by its bytes alone:
    EXACT words of 64 bits expanded from a 128-bit hash of the line; and ALIKE lanes that
    get plus or minus one for each run of `SHINGLE` words in the line (of all its words,
    if fewer), lane and sign picked by the run's hash. A text's fingerprint is the sum
    of its paragraphs' vectors, lane by lane, modulo 2**64 and 2**16: whatever the
    paragraphs' order, and a paragraph can be added or taken out without the others.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split(b"\n") for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        digest = xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join([digest(line) for lines in split for line in lines]), dtype="<u8").reshape(-1, 2)
        self.exact = np.zeros((len(texts), EXACT), dtype=np.uint64)
        for k in range(EXACT):
            lane = mix(hashes[:, 0] ^ _NUMBERS[k]) + mix(hashes[:, 1] + _NUMBERS[k])
            np.add.at(self.exact[:, k], owner, lane)
        joined = b"\n".join(texts) + b"\n"
        data = np.zeros(len(joined) + 8, dtype=np.uint8)
        data[:-8] = np.frombuffer(joined, dtype=np.uint8)
        ends = np.flatnonzero(data[:-8] == 0x0A) + 1
        starts, lengths, line = words_of(data, np.concatenate([[0], ends]))
        words = hash_words(data, starts, lengths)
        n = len(words)
        runs = words.copy()
        for step in range(1, SHINGLE):
            at = np.flatnonzero(line[step:] == line[: max(0, n - step)]) if n > step else np.zeros(0, dtype=np.int64)
            runs[at] = join_hash(runs[at], words[at + step])
        keep = np.ones(n, dtype=bool)  # runs of full length, and the first of a line
        keep[1:] = line[1:] != line[:-1]
        full = max(0, n - SHINGLE + 1)
        keep[:full] |= line[SHINGLE - 1 :] == line[:full] if full else False
        runs, rows = runs[keep], owner[line[keep]]
        lane = rows * ALIKE + (runs & np.uint64(ALIKE - 1)).astype(np.int64)
        sign = 1 - 2 * ((runs >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        sums = np.bincount(lane, sign, minlength=len(texts) * ALIKE)
        self.alike = sums.astype(np.int64).astype(np.int16).reshape(len(texts), ALIKE)

    def __getitem__(self, rows: slice) -> Prints:
        part = object.__new__(Prints)
        part.exact, part.alike = self.exact[rows], self.alike[rows]
        return part

    def hex(self) -> list[str]:
        """The fingerprints as text: lower-case hex, exact lanes first, little-endian."""
        whole = np.concatenate([self.exact.astype("<u8").view(np.uint8), self.alike.astype("<i2").view(np.uint8)], axis=1)
        return [row.tobytes().hex() for row in whole]


def parse(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    return raw[:, : 8 * EXACT].copy().view("<u8"), raw[:, 8 * EXACT :].copy().view("<i2")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a text with the paragraphs of both (sign -1: those of b taken out of a)."""
    (x, y), (u, v) = parse([a]), parse([b])
    exact = x + u if sign > 0 else x - u
    alike = y + v if sign > 0 else y - v
    return (exact.astype("<u8").tobytes() + alike.astype("<i2").tobytes()).hex()


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Estimated share, 0 to 1, of what both have: 2 <a, b> / (<a, a> + <b, b>) on the `alike` lanes.

    The lanes are a random projection of the run counts, so their inner products are
    unbiased estimates. Texts with equal fingerprints get 1; negative estimates 0.
    """
    x, y = a.astype(np.float64), b.astype(np.float64)
    norms = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    share = np.divide(2 * (x * y).sum(axis=1), norms, out=np.zeros(len(x)), where=norms > 0)
    return np.where(same, 1.0, np.clip(share, 0.0, 1.0 - 1e-9))


def fingerprint(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add `fingerprint` to each row of `docs`; a null text is empty. `keep`: other columns to return (all).

    Where one of these has the name, the new column gets a `_` more.
    """
    names = list(docs.columns if keep is None else keep)
    made = free_name("fingerprint", names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.large_binary())
            for rows in _groups([len(x) for x in map(_bytes, raw)]):
                part = batch.slice(rows.start, len(rows))
                found = Prints([_bytes(x) for x in raw[rows.start : rows.stop]]).hex()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found)], names=[*names, made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, ", ".join([*fields, f"`{made}` string"]))


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_py() or b""


def _groups(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[range]:
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield range(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield range(begin, len(sizes))


class Ranges:
    """Ids cut into ranges, descending; an id with very much text is cut once more, by a hash of the text.

    cuts: ascending; a key is in the range numbered by the cuts above it. shares: the
    parts of each range that is cut (it has one key). firsts: the first (key, hash) of each part.
    """

    def __init__(self, cuts: list[int], shares: dict[int, int] | None = None, firsts: dict[int, tuple[int, int]] | None = None):
        self.cuts = np.array(cuts, dtype=np.int64)
        self.shares = np.array([(shares or {}).get(i, 1) for i in range(len(cuts) + 1)], dtype=np.int64)
        self.bases = np.cumsum(self.shares) - self.shares
        self.parts = int(self.shares.sum())
        order = sorted(firsts or {})
        self.before: dict[tuple[int, int], int] = {firsts[p]: order[i - 1] for i, p in enumerate(order)} if firsts else {}  # the first follows the last

    def range(self, keys: np.ndarray) -> np.ndarray:
        return (len(self.cuts) - np.searchsorted(self.cuts, keys, side="right")).astype(np.int32)

    def part(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = self.range(keys)
        high = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # ascends with the signed hash
        within = (high * self.shares[at].astype(np.uint64)) >> np.uint64(32)
        return (self.bases[at] + within.astype(np.int64)).astype(np.int32)


def with_successors(docs: DataFrame, part_bytes: int = 32 << 20, most_parts: int = 100_000) -> DataFrame:
    """Rows (part, last, key, text) dealt and sorted so that each task sees neighbours in descending id order.

    Ids are cut into ranges of about `part_bytes` of text, no more than `most_parts`;
    each is one partition, but for a range of a single id (rows without one, say) with more text, which is cut by a hash of
    the text. The first document of the next part comes once more at the
    end of a part (`last`), and the first of all after the last, so that every document
    meets its successor though nothing is sorted in one place. The driver holds one cut
    and one key a part. Rows of one id are ordered by a hash of the text, then by text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(id_key().alias("key"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    total = bytes_estimate(keyed, "text")
    parts = min(most_parts, max(1, -(-total // part_bytes), min(spark.sparkContext.defaultParallelism, total >> 20)))
    cuts: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = keyed.agg(F.percentile_approx("key", shares, max(10_000, 10 * parts)).alias("c")).first().c
        cuts = sorted(set(found or []))
        cuts = sorted({*cuts, *(c + 1 for c in cuts if c + 1 <= 2**63 - 1)}) if len(cuts) < parts - 1 else cuts  # an id that is many cuts stands alone

    def numbered(ranges: Ranges) -> DataFrame:
        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, hashes = batch.column("key").to_numpy(), batch.column("hash").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ranges.part(keys, hashes)), *batch.columns], names=["part", "key", "hash", "size"])

        return keyed.select("key", "hash", F.octet_length("text").cast("long").alias("size")).mapInArrow(number, "part int, key long, hash long, size long")

    def firsts(ranges: Ranges) -> list:
        first = F.struct((-F.col("key").cast("decimal(20,0)")).alias("back"), F.col("hash"))
        return numbered(ranges).groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("key"), F.min(first).alias("f"), F.sum("size").alias("size")).collect()

    ranges = Ranges(cuts)
    found = firsts(ranges)
    most = max(part_bytes, total // max(1, parts))
    split = {r.part: min(4096, -(-r.size // most)) for r in found if r.low == r.key and r.size > 2 * most}
    if split:
        found = firsts(ranges := Ranges(cuts, split))
    ranges = Ranges(cuts, split, {r.part: (r.key, r.f.hash) for r in found})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "last", "key", "hash", "text"]
        for batch in batches:
            keys, hashes = batch.column("key").to_numpy(), batch.column("hash").to_numpy()
            columns = [pa.array(ranges.part(keys, hashes)), pa.array(np.zeros(len(keys), dtype=bool)), batch.column("key"), batch.column("hash"), batch.column("text")]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            again = [(i, ranges.before[pair]) for i, pair in enumerate(zip(keys.tolist(), hashes.tolist(), strict=True)) if pair in ranges.before]
            if again:
                copied = batch.take(pa.array([i for i, _ in again]))
                before = pa.array([p for _, p in again], pa.int32())
                yield pa.RecordBatch.from_arrays([before, pa.array([True] * len(again)), copied.column("key"), copied.column("hash"), copied.column("text")], names=names)

    dealt = keyed.select("key", "hash", "text").mapInArrow(deal, "part int, last boolean, key long, hash long, text string")
    return dealt.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", "last", F.desc("key"), "hash", "text").drop("hash")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, and compare it with that and with the next text.

    Edited: the last half of the code points (rounded down) replaced by as many first
    code points of the next document, in descending id order; the first follows the
    last. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; one row for each input row, null texts as empty ones.
    """

    def group(rows: list[tuple[int, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, [*texts[1:], following], strict=True)]
        raw = [t.encode() for t in edited]
        n = len(texts)
        own, new = Prints([t.encode() for t in [*texts, following]]), Prints(raw)
        same = lambda a, b: (a.exact == b.exact).all(axis=1) & (a.alike == b.alike).all(axis=1)
        first, after = own[:n], own[1:]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array(first.hex()),
                pa.array(new.hex()),
                pa.array(likeness(first.alike, new.alike, same(first, new))),
                pa.array(likeness(first.alike, after.alike, same(first, after))),
            ],
            names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size, part, closed = 0, None, False
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "last", "key", "text")), strict=True)
            for p, last, key, text in rows:
                if p != part:
                    part, closed = p, False
                if last:
                    if not closed and held:
                        yield group(held, text)
                    held, size, closed = [], 0, True
                    continue
                if size > SLICE_BYTES // 2:
                    yield group(held, text)
                    held, size = [], 0
                held.append((key, text))
                size += len(text)

    schema = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_successors(docs).mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the columns of `compare_edited`."""
    found = compare_edited(docs.select("doc_id", "text"))
    return found.select(id_back(F.col("key")).alias("doc_id"), *[c for c in found.columns if c != "key"])
