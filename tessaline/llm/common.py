"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.sources.shared import shared_folder
from tessaline.sources.tables import spread, table

#: Stands for a null document id wherever ids are compared; it sorts first.
NULL_ID = -(2**63)
#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def id_key(column: str = "doc_id") -> Column:
    """`column` as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    """The document id behind `id_key`."""
    return F.when(column != F.lit(NULL_ID), column)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chance(*parts: Column | str) -> Column:
    """A number from 0 up to 1 fixed by a hash of `parts`; 53 bits, so that the smallest shares keep their rows."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many `_` behind as no column of `taken` (names compared without case) has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def join_unequal(rows: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined to `small` (one row a key, `n`: how many of `rows` have it) by `keys`.

    A key that more than one in 4,096 of the `total` rows have doesn't go to one task:
    there are at most 4,096 such keys, whose rows of `small` are broadcast; all others
    are joined by a shuffle. Without `n` in the result.
    """
    limit = max(16, -(-total // 4096))
    hot = F.broadcast(small.filter(F.col("n") > limit).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(small.filter(F.col("n") <= limit).drop("n"), keys)
    return rows.join(hot, keys).unionByName(rest)


class Written:
    """A table written to the shared folder, which cuts the lineage behind it."""

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tessaline-{uuid.uuid4().hex}/{what}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path.getParent(), True)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree and others) with `i`, the place in the tree by `order`, and `n`, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so that a tree with most of the rows is
    spread over many tasks. Places follow from the number of a row in its range and the
    rows of the tree in earlier ranges; that table has a row for each range, and one
    more for each tree.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = Written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").df
    part = F.shiftright("_at", 33).alias("_part")
    runs = held.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tree = W.partitionBy("tree")
    before = runs.select(
        "tree", "_part", "_first", F.sum("_rows").over(tree).alias("n"),
        (F.sum("_rows").over(tree.orderBy("_part")) - F.col("_rows")).alias("_before"),
    )
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return held.select("*", part).join(before, ["tree", "_part"]).select(*rows.columns, place.alias("i"), "n")


# -- texts as numpy arrays ---------------------------------------------------

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_K3 = np.uint64(0x165667B19E3779F9)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text (one row at least)."""
    array = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    row = 0
    while row < batch.num_rows:
        base = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(row, end - row)
        row = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an array, padded by 8, and the row offsets (a null is empty)."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    out = np.zeros(last - first + 8, dtype=np.uint8)
    if last > first:
        out[:-8] = np.frombuffer(data, dtype=np.uint8)[first:last]
    return out, (offsets - first if n else np.zeros(1, dtype=np.int64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each word `[^\\x20\\x09-\\x0D]+` in `text_bytes` output."""
    size = int(offsets[-1])
    word = ~_SEPARATOR[data[:size]]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:size]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:size]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return starts, lengths, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _K2
    h ^= h >> np.uint64(29)
    h *= _K3
    h ^= h >> np.uint64(32)
    return h


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; eight bytes a step, only over the words that go on."""
    view = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    h = lengths.astype(np.uint64) * _K1 + np.uint64(seed)
    rows, at, rest = np.arange(len(starts)), starts, lengths
    while len(rows):
        chunk = view[at]
        short = rest < 8
        bits = (np.minimum(rest, 7) * 8).astype(np.uint64)
        chunk = np.where(short, chunk & ((np.uint64(1) << bits) - np.uint64(1)), chunk)
        h[rows] = mix(h[rows] ^ chunk) if len(rows) < len(h) else mix(h ^ chunk)
        more = rest > 8
        rows, at, rest = rows[more], at[more] + 8, rest[more] - 8
    return h


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two sequences, one behind the other, from the hashes of both."""
    return mix(a * _K1 + (b ^ (b >> np.uint64(31))) * _K3)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, built by doubling; entry i is the run that starts at word i.

    Runs that go over a row's end are garbage; callers leave them out. For a power of
    two times an odd number, equal lengths built from any place give equal hashes.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if length == 1:
        return words
    if length % 2 == 0:
        half = window_hashes(words, length // 2)
        return join_hash(half[:n], half[length // 2 : length // 2 + n])
    rest = window_hashes(words, length - 1)
    return join_hash(rest[:n], words[length - 1 : length - 1 + n])


def bytes_estimate(df: DataFrame, column: str) -> int:
    """Bytes of one text column over the whole table (one scan)."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)
