"""Tokenised documents packed into sequences by bounded-space online best fit."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, free_name, spread, text_slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
OPEN_BINS = 256
#: Pieces that are looked ahead: within a run of so many the long ones are placed first.
RUN = 1024
#: Sequences that one task packs, about.
TASK_SEQUENCES = 8192


class Tokenizer:
    """The ids of a byte-level BPE vocabulary file, as little-endian 32-bit bytes."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = coder.encode_ordinary
        self._split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _plain(self, text: str) -> bytes:
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of a whole text; the strings of special tokens are those tokens."""
        if not self._split or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def pieces(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """The token pieces of each row of `docs` (doc_id, text; a null text is empty).

    A text's ids and `end_id` are one piece if they fit `capacity`; else they are cut
    into pieces of `capacity`, the first of which takes what is left over. Returns
    doc_id, piece, start, length, ids_crc32 and, with `keep_ids`, ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = tokenizer(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in text_slices(batch):
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text or "") + last
                    total = len(ids) // 4
                    start, end, piece = 0, total % capacity or min(capacity, total), 0
                    while start < total:
                        cut = ids[4 * start : 4 * end]
                        out.append((doc, piece, start, end - start, zlib.crc32(cut), cut))
                        start, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*out, strict=True)) or [()] * 6
                types = [part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], types, strict=True)]
                if keep_ids:
                    arrays.append(pa.array([memoryview(c).cast("I").tolist() for c in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


class BestFit:
    """At most `open_bins` open bins; a bit set holds which free spaces occur among them."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.count = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset of a piece: the fullest open bin it fits, or else a new one."""
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length}, which must be 1 to {self.capacity} long")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.open_bins:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.count
            self.count += 1
        left = free - length
        if left:
            if not self.bins[left]:
                self.bits |= 1 << left
            self.bins[left].append(bin_)
            self.open += 1
        return bin_, self.capacity - free


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, run: int = RUN, task_sequences: int = TASK_SEQUENCES) -> DataFrame:
    """Give each piece of `found` (doc_id, piece, length and any columns) a sequence_id and an offset.

    Pieces are dealt over tasks by a hash of all that is known of them and their place in the stored table (so that
    rows that share an id, or have none, are spread too), as many tasks as sequences of `capacity` need
    at `task_sequences` each; each task packs its share online, as the pieces come in the
    order of a hash, with `open_bins` open bins, fewer than its sequences, and a look
    ahead of `run` pieces, of which the long ones go first. Its memory doesn't grow with
    the input. Where no open bin has room and all may be open,
    the fullest closes first. The order is fixed, so that a task that runs again gives the
    same places. Repeated rows are pieces each; an empty table gives none. A piece that
    isn't 1 to `capacity` long is an error. Where `found` has a column of one of the new names, the new one
    gets a `_` more.
    """
    at = free_name("_at", found.columns)
    stored = Written(found.withColumn(at, F.monotonically_increasing_id()), "pieces").df
    total = stored.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // (capacity * task_sequences)))
    names = found.columns
    new = [free_name(c, names) for c in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.take(np.argsort(-rows.column("length").to_numpy(), kind="stable")).combine_chunks()
            places = [bins.place(n) for n in rows.column("length").to_pylist()]
            columns = [rows.column(c).combine_chunks() for c in names]
            made = [pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *new])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= run:
                rows = pa.Table.from_batches(held)
                full = rows.num_rows - rows.num_rows % run
                for begin in range(0, full, run):
                    yield placed(rows.slice(begin, run))
                held = rows.slice(full).to_batches()
        if sum(b.num_rows for b in held):
            yield placed(pa.Table.from_batches(held))

    mixed, known = F.xxhash64("doc_id", "piece", "start"), F.xxhash64("doc_id", "piece", "start", "length", at)
    dealt = stored.repartitionById(tasks, F.pmod(known, F.lit(tasks)).cast("int")) if tasks > 1 else stored.coalesce(1)
    ordered = dealt.sortWithinPartitions(mixed, known, at).drop(at)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ordered.mapInArrow(place, f"{fields}, `{new[0]}` long, `{new[1]}` long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, from packed pieces with ids."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda x: x.ids)).alias("ids"))


def op2(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs))
