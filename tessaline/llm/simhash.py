"""SimHash near-duplicates, joined through pivot distance tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import NULL_ID, Written, id_back, id_key, join_unequal, shuffle_partitions, spread, text_slices
from tessaline.llm.components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at once; bounds memory for very long texts.
_CHUNK = 1 << 18
#: Members of a bucket compared in one unit; larger buckets become pairs of such parts.
UNIT = 512
#: Reference fingerprints; their distances take a byte each in one long.
PIVOTS = 8


def simhash_bytes(text: bytes, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: a bit is set if over half of the shingles' XXH64 have it."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))) + np.arange(len(words))
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    count, digest = len(words) - k + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, _CHUNK):
        to = min(count, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        hashes = np.fromiter([digest(joined[s:e], seed) for s, e in spans], dtype="<u8", count=to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, fp) for each row: `id_key` of the id and the SimHash as a signed long.

    Whole texts; a null text or one without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                prints = np.array([simhash_bytes(t or b"", shingle) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(prints.view(np.int64))], names=["key", "fp"])

    rows = spread(docs.select(id_key(id_column).alias("key"), F.col(text_column).alias("text")))
    return rows.mapInArrow(run, "key long, fp long")


def _pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words, 32 bits set on average."""
    return np.random.default_rng(20).integers(0, 2**64, size=count, dtype=np.uint64, endpoint=False)


def pivot_table(fp: Column) -> Column:
    """The Hamming distances of a fingerprint to all pivots, a byte each, as one long."""
    table = F.lit(0).cast("long")
    for i, pivot in enumerate(_pivots().view(np.int64).tolist()):
        table = table.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * i))
    return table


def close_links(fp: np.ndarray, table: np.ndarray, unit: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at `distance` or fewer bits within the same unit; rows are sorted by unit, then side.

    Side 0 and 2 are the two parts of a unit that compares part against part, side 1 is
    a part compared with itself. `table`: the distances to the pivots, as `pivot_table`
    made them once for each class; by the triangle inequality a pair is out as soon as
    one coordinate differs by more than `distance`. Survivors are verified.
    """
    table = np.ascontiguousarray(table.astype("<i8").view(np.int8).reshape(-1, PIVOTS).T)
    left, right = [], []
    last = np.searchsorted(unit, unit, side="right")
    index = np.arange(len(fp))
    shift = 1
    while len(index := index[index + shift < last[index]]):
        a, b = index, index + shift
        keep = np.abs(table[0][a] - table[0][b]) <= distance
        keep &= ((side[a] == 1) & (side[b] == 1)) | (side[a] != side[b])
        a, b = a[keep], b[keep]
        for row in table[1:]:
            keep = np.abs(row[a] - row[b]) <= distance
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        left.append(a[keep])
        right.append(b[keep])
        shift += 1
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def stars(a: np.ndarray, b: np.ndarray, vertex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (index pairs) as stars: each vertex that has a link with the least vertex its links lead to."""
    label = vertex.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if np.array_equal(before, label):
            break
    linked = np.unique(np.concatenate([a, b]))
    linked = linked[label[linked] != vertex[linked]]
    return vertex[linked], label[linked]


def _blocks(count: int) -> list[int]:
    """Masks that cut 64 bits into `count` blocks."""
    edges = [round(i * 64 / count) for i in range(count + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def spare_blocks(distance: int, count: int) -> int:
    """How many blocks make a key: enough that `count` spread fingerprints leave about 16 in a bucket."""
    spare = 2
    while spare * 64 / (distance + spare) < math.log2(max(2, count)) - 4 and spare < 6:
        spare += 1
    return spare


def _keys(fp: Column, distance: int, spare: int) -> Column:
    """Keys of a fingerprint: of `distance` + `spare` blocks, `spare` at least are equal in a close pair."""
    blocks = _blocks(distance + spare)
    masks = [sum(chosen) for chosen in combinations(blocks, spare)]
    return F.array(*[F.struct(F.lit(i).cast("int").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])


def links_between(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between classes (rep, fp) whose fingerprints differ in at most `distance` bits.

    Not every pair: within each unit of work the pairs found are reduced to stars, which
    connect the same classes. Nothing is left out: two fingerprints that close agree on
    `spare` of `distance` + `spare` blocks of bits, so they meet in these blocks' bucket,
    whichever number of spare blocks the count of classes suggests.
    Buckets over `UNIT` members are cut into parts by a hash, each pair of parts is a
    unit of its own, so that no task holds a whole bucket.
    """
    fp, spare = F.col("fp"), spare_blocks(distance, classes.count())
    keyed = classes.select("rep", "fp", pivot_table(fp).alias("far"), F.explode(_keys(fp, distance, spare)).alias("k")).select("rep", "fp", "far", "k.t", "k.v")
    sizes = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(UNIT)).cast("int")
    part = F.pmod(F.xxhash64("rep", "t"), F.col("p")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("p") - 1),
        lambda j: F.struct(
            F.least(j, F.col("c")).alias("i"),
            F.greatest(j, F.col("c")).alias("j"),
            F.when(j == F.col("c"), 1).when(j > F.col("c"), 0).otherwise(2).alias("side"),
        ),
    )
    units = (
        keyed.join(sizes, ["t", "v"])
        .select("rep", "fp", "far", "t", "v", parts.alias("p"))
        .select("rep", "fp", "far", "t", "v", "p", part.alias("c"))
        .select("rep", "fp", "far", "t", "v", F.explode(others).alias("o"))
        .select("rep", "fp", "far", F.col("o.side").cast("int").alias("side"), "t", "v", "o.i", "o.j")
        .repartition(shuffle_partitions(classes.sparkSession), "t", "v", "i", "j")
        .sortWithinPartitions("t", "v", "i", "j", "side")
    )

    def solve(rows: pa.Table) -> pa.RecordBatch:
        col = lambda n: rows.column(n).to_numpy()
        new = np.zeros(rows.num_rows, dtype=bool)
        for name in ("t", "v", "i", "j"):
            values = col(name)
            new[1:] |= values[1:] != values[:-1]
        rep = col("rep")
        a, b = close_links(col("fp").view(np.uint64), col("far"), np.cumsum(new), col("side"), distance)
        far, near = stars(a, b, rep) if len(a) else (rep[:0], rep[:0])
        return pa.RecordBatch.from_arrays([pa.array(far), pa.array(near)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tail = [batch.column(n)[batch.num_rows - 1].as_py() for n in ("t", "v", "i", "j")]
            same = np.ones(batch.num_rows, dtype=bool)
            for name, value in zip(("t", "v", "i", "j"), tail, strict=True):
                same &= batch.column(name).to_numpy() == value
            cut = int(np.argmax(same))
            if cut:  # the last unit of a batch may go on in the next
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return units.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, distance: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprint every document and group those linked, directly or over others.

    Returns (key, fp, component): one row for each input row; `key` and `component` are
    `id_key` values, the component's being the smallest key reachable. Equal
    fingerprints (those of exact copies, of empty and of null texts among them) are one
    class, whatever their number; only class representatives are joined. Rows that
    repeat an id each get their row; such an id is in the components of all its rows,
    which are thereby one. Null ids share one key, which sorts first.
    """
    prints = Written(fingerprints(docs, shingle, id_column, text_column), "prints")
    classes = Written(prints.df.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "classes")
    many = prints.df.groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("key")
    repeated = prints.df.join(many, "key")  # ids with several texts; by id first, as copies may share one fingerprint
    shared = repeated.join(classes.df.select("fp", "rep"), "fp").filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    links = links_between(classes.df.select("rep", "fp"), distance).unionAll(shared)
    components = connected_components(links)
    labels = classes.df.join(components, F.col("rep") == F.col("vertex"), "left").select(
        "fp", "n", F.coalesce("component", "rep").alias("component")
    )
    # a fingerprint can have a third of all rows
    return join_unequal(prints.df, Written(labels, "labels").df, ["fp"], prints.df.count()).select("key", "fp", "component")


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, with 4-word shingles."""
    found = near_duplicates(docs, shingle=4, distance=4)
    return found.select(
        id_back(F.col("key")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_back(F.col("component")).alias("component_id"),
    )


__all__ = ["NULL_ID", "close_links", "fingerprints", "links_between", "near_duplicates", "op5", "simhash_bytes"]
