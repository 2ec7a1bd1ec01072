"""Sums of array columns by group, in Arrow: partial sums in each task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds at once; beyond it they go on as they are and meet others later.
HELD = 64 << 20
#: Partial sums of a key that one task adds up; more are first added up in parts.
FAN = 64

Batches = Iterator[pa.RecordBatch]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def array_column(rows: np.ndarray) -> pa.Array:
    """Rows of doubles as a column of arrays."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def group_starts(keys: pa.Array) -> np.ndarray:
    """Where a new key begins, in keys that stand together and are never null."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=np.int64)
    new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def whole_groups(batches: Batches, key: str) -> Iterator[pa.Table]:
    """Batches sorted by `key`, cut anew so that no key's rows are in two of them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows.column(key).combine_chunks()
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last = int(group_starts(keys)[-1])
        if last:
            yield pa.concat_tables([*held, rows.slice(0, last)]).combine_chunks()
            held, rows = [], rows.slice(last)
        held.append(rows)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def by_group(rows: DataFrame, key: str, order: list[str], run: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """`run` over the rows of whole groups of `key` (never null, each small): it gets a table and where its groups begin."""

    def over(batches: Batches) -> Batches:
        for table in whole_groups(batches, key):
            yield run(table, group_starts(table.column(key).combine_chunks()))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(over, schema)


def sum_arrays(rows: DataFrame, key: str, column: str, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, sums): for each key of `rows` (never null) its arrays added up, place by place.

    The arrays have one length. `fold` makes one array of a matrix of some of a key's
    rows, such that arrays of parts can be added up; without it these are plain sums.
    Each task adds up its own rows; what it has of a key is one row of the shuffle.
    Where more than `FAN` tasks can have a key, their sums are first added up in `FAN`
    parts of it, as a tree.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, part int, sums array<double>"

    def emit(held: dict, arrow: pa.DataType) -> pa.RecordBatch:
        part = np.full(len(held), TaskContext.get().partitionId() % FAN, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(list(held), arrow), pa.array(part), array_column(np.array(list(held.values())))], names=[key, "part", "sums"])

    def partial(batches: Batches) -> Batches:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(key).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            values = matrix(batch.column(column))[order]
            sums = np.add.reduceat(values, starts, axis=0) if fold is None else [fold(part) for part in np.split(values, starts[1:])]
            for name, total in zip(coded.dictionary.to_pylist(), sums, strict=True):  # codes ascend in the order of the dictionary
                held[name] = held[name] + total if name in held else total
            if held and len(held) * 8 * len(next(iter(held.values()))) > HELD:
                yield emit(held, batch.schema.field(key).type)
                held = {}
        if held:
            yield emit(held, batch.schema.field(key).type)

    def merge(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sums = np.add.reduceat(matrix(table.column("sums")), starts, axis=0)
        keys = table.column(key).combine_chunks().take(pa.array(starts))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.zeros(len(starts), dtype=np.int32)), array_column(sums)], names=[key, "part", "sums"])

    found = rows.select(key, column).mapInArrow(partial, schema)
    if found.rdd.getNumPartitions() > FAN:

        def merge_parts(batches: Batches) -> Batches:
            for table in whole_groups(batches, "_both"):
                yield merge(table.drop_columns(["_both"]), group_starts(table.column("_both").combine_chunks()))

        both = F.concat_ws(":", "part", F.col(key).cast("string"))
        found = found.withColumn("_both", both).repartition("_both").sortWithinPartitions("_both").mapInArrow(merge_parts, schema)
    return by_group(found, key, [], merge, schema).drop("part")
