"""Removal of word runs that repeat earlier text, found by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessaline.llm.common import (
    Written,
    free_name,
    hash_words,
    id_key,
    join_hash,
    mix,
    shuffle_partitions,
    spread,
    text_bytes,
    text_slices,
    window_hashes,
    words_of,
)

#: Names that no input column is expected to have.
_KEY, _FLAGS, _OPEN = "__tessaline_key", "__tessaline_flags", "__tessaline_open"
#: Rows that a task holds to combine equal windows before the shuffle.
_HELD = 1 << 20
_ROW = np.uint64(0xD6E8FEB86659FD93)
_SECOND = 0x5851F42D4C957F2D


class Level:
    """The words of some texts, their windows of `base` words, and those of twice the length.

    Of the windows of `base` words within a long window, the one with the least hash
    (leftmost of equals) stands for it: equal long windows have equal ones. Consecutive
    long windows with the same stand-in are a run; `value` is the stand-in's hash, `run`
    the hash of all words the run covers.
    """

    def __init__(self, texts: pa.Array, base: int):
        self.base, self.length = base, 2 * base
        self.data, self.offsets = text_bytes(texts)
        self.starts, self.lengths, self.rows = words_of(self.data, self.offsets)
        words = hash_words(self.data, self.starts, self.lengths)
        short = window_hashes(words, base)
        n = max(0, len(words) - self.length + 1)
        valid = np.flatnonzero(self.rows[: n] == self.rows[self.length - 1 :][:n]) if n else np.zeros(0, dtype=np.int64)
        self.at = valid
        if not len(valid):
            self.window = self.value = self.run = np.zeros(0, dtype=np.uint64)
            self.run_row = np.zeros(0, dtype=np.int64)
            self.of = np.zeros(0, dtype=np.int64)
            return
        self.window = join_hash(short[:n], short[base : base + n])[valid]
        stand = self._least(short, base + 1)[valid]
        first = np.ones(len(valid), dtype=bool)
        first[1:] = stand[1:] != stand[:-1]
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(valid)) - 1
        self.of = np.cumsum(first) - 1
        self.value = short[stand[begin]]
        span = (valid[end] - valid[begin]).astype(np.uint64)
        self.run = join_hash(join_hash(self.value, self.window[begin]), self.window[end] + span * _ROW)
        self.run_row = self.rows[valid[begin]]

    def second(self) -> np.ndarray:
        """Hashes of the long windows that don't depend on `window`: with both, equality rests on 128 bits."""
        other = window_hashes(hash_words(self.data, self.starts, self.lengths, seed=_SECOND), self.length)
        return other[self.at]

    @staticmethod
    def _least(values: np.ndarray, width: int) -> np.ndarray:
        """For each start, the index of the leftmost minimum among the next `width` values."""
        best, size = np.arange(len(values)), 1
        while 2 * size <= width:
            a, b = best[:-size], best[size:]
            best, size = np.where(values[a] <= values[b], a, b), 2 * size
        if size < width:
            a, b = best[: size - width], best[width - size :]
            best = np.where(values[a] <= values[b], a, b)
        return best


def _combined(group: np.ndarray, item: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Rows (p, x, key) for `_settle`, from (group, item, key).

    Of equal (group, item) only the one with the smallest key needs comparing with other
    tasks (p is the group); all others start later than it for certain and are settled
    here (p is the key itself, the key null). A passage in a third of all documents thus
    sends one row a task to its group, not one a document.
    """
    order = np.lexsort((key, item, group))
    group, item, key = group[order], item[order], key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (group[1:] == group[:-1]) & (item[1:] == item[:-1])
    again = same.copy()
    again[1:] &= key[1:] == key[:-1]
    p = np.where(same, key, group.view(np.int64))
    keys = pa.array(key, mask=same)
    rows = pa.RecordBatch.from_arrays([pa.array(p), pa.array(item.view(np.int64)), keys], names=["p", "x", "key"])
    # a key that is its group's smallest several times is one occurrence
    least = key[np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))] if len(key) else key
    return rows.filter(pa.array(~again & ~(same & (key == least))))


def _held(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= _HELD:
            yield _combined(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield _combined(*map(np.concatenate, zip(*held, strict=True)))


def _settle(rows: DataFrame) -> DataFrame:
    """(key, hash, open): what starts later than an equal (open false); groups whose items differ (open true)."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "p")
    seen = dealt.withColumn("least", F.min("key").over(W.partitionBy("p", "x"))).select(
        "*", F.min("x").over(W.partitionBy("p")).alias("lo"), F.max("x").over(W.partitionBy("p")).alias("hi")
    )
    later = F.col("key").isNull() | (F.col("key") > F.col("least"))
    return seen.filter(later | (F.col("lo") != F.col("hi"))).select(
        F.coalesce("key", "p").alias("key"), F.when(later, F.col("x")).otherwise(F.col("p")).alias("hash"), (~later).alias("open")
    )


def _member(row: np.ndarray, item: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether `item` is in the list (of longs, may be null) of its row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
    if not len(flat):
        return np.zeros(len(item), dtype=bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    tag = lambda r, x: mix(x ^ (r.astype(np.uint64) * _ROW))
    return np.isin(tag(row, item), tag(owner, flat))


def later_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(key, flags): for each document, hashes of its windows and runs of windows that occur earlier.

    `docs` has `_KEY` (long, not null) and text. Level one: windows of half the length,
    thinned to stand-ins; those alone in the corpus go. Level two: what repeats is
    extended to the full length; where nothing repeats, there is no second level. Runs
    whose words agree in every place are settled as one; only where neighbours differ are
    windows compared one by one. Both comparisons rest on two hashes of 64 bits each.
    """
    base = window // 2
    if window < 4 or window % 2:
        raise ValueError("the window must be an even number of words, 4 at least")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for part in text_slices(batch):
                    level = Level(part.column("text"), base)
                    if len(level.run):
                        yield level.value, level.run, part.column(_KEY).to_numpy()[level.run_row]

        yield from _held(parts())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for part in text_slices(batch):
                    level = Level(part.column("text"), base)
                    if not len(level.run):
                        continue
                    take = _member(level.run_row, level.value, part.column(_OPEN))
                    take &= ~_member(level.run_row, level.run, part.column(_FLAGS))
                    take = take[level.of]
                    yield level.second()[take], level.window[take], part.column(_KEY).to_numpy()[level.rows[level.at[take]]]

        yield from _held(parts())

    schema = "p long, x long, key long"
    first = _settle(spread(docs.select(_KEY, "text")).mapInArrow(runs, schema))
    marks = first.groupBy("key").agg(
        F.collect_list(F.when(~F.col("open"), F.col("hash"))).alias(_FLAGS),
        F.collect_list(F.when(F.col("open"), F.col("hash"))).alias(_OPEN),
    )
    marks = Written(marks, "marks").df
    if marks.isEmpty():  # no candidate survives
        return marks.select(F.col("key").alias(_KEY), _FLAGS)
    # all columns of `docs` go along, so that this join and the caller's read one shuffle of the texts
    mixed = docs.join(marks.filter(F.size(_OPEN) > 0).withColumnRenamed("key", _KEY), _KEY)
    second = _settle(mixed.mapInArrow(windows, schema)).filter("NOT open")
    flags = marks.select("key", F.explode(_FLAGS).alias("hash")).unionAll(second.select("key", "hash"))
    return flags.groupBy(F.col("key").alias(_KEY)).agg(F.collect_list("hash").alias(_FLAGS))


def removed_words(level: Level, flags: pa.Array) -> np.ndarray:
    """For each word, whether a window over it also starts earlier, in another document or this one."""
    gone = np.zeros(len(level.starts) + 1, dtype=np.int64)
    if len(level.run):
        rows = level.rows[level.at]
        later = _member(level.run_row, level.run, flags)[level.of] | _member(rows, level.window, flags)
        _, firsts = np.unique(mix(level.window ^ (rows.astype(np.uint64) * _ROW)), return_index=True)
        again = np.ones(len(rows), dtype=bool)
        again[firsts] = False
        at = level.at[later | again]
        gone += np.bincount(at, minlength=len(gone)) - np.bincount(at + level.length, minlength=len(gone))[: len(gone)]
    return np.cumsum(gone)[:-1] > 0


def drop_repeats(docs: DataFrame, window: int = 20, joined: bool = False) -> DataFrame:
    """Cut from each text the words covered by a window of `window` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier place in the same text. All windows are
    judged on the input. Returns the columns of `docs` (one row for each input row; the
    text with its repeats cut, other columns as they were) and n_words, n_removed, spans
    (removed runs as structs of first and end word); where `docs` has one of these names,
    the new column gets a `_` more. `joined`: the kept words joined by
    one space; else what lies between kept words stays, and an untouched text is
    unchanged. A null text counts as no words (and stays null, or becomes empty if
    `joined`). Null ids come first; rows of one id are each judged against other ids
    and themselves only. An empty table gives an empty result.
    """
    base = window // 2
    names = docs.columns
    made_names = [free_name(c, names) for c in ("n_words", "n_removed", "spans")]
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn(_KEY, id_key())
    flagged = keyed.join(later_windows(keyed, window), _KEY, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield _cut(part)

    def _cut(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.large_string())
        level = Level(texts, base)
        gone = removed_words(level, part.column(_FLAGS))
        n_words = np.bincount(level.rows, minlength=part.num_rows)
        n_gone = np.bincount(level.rows[gone], minlength=part.num_rows)
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        raw = texts.cast(pa.large_binary())
        kept, spans = [], []
        for i in range(part.num_rows):
            lo, hi = bounds[i], bounds[i + 1]
            text = raw[i].as_py()
            if n_gone[i]:
                mask = gone[lo:hi]
                turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"first": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            else:
                spans.append([])
            if joined:
                words = (text or b"").split()
                kept.append(b" ".join(compress(words, (~gone[lo:hi]).tolist()) if n_gone[i] else words))
            elif not n_gone[i]:
                kept.append(text)
            else:
                start = level.starts[lo:hi] - level.offsets[i]
                stop = start + level.lengths[lo:hi]
                live = np.flatnonzero(np.diff(np.concatenate([[False], ~mask, [False]]).astype(np.int8))).reshape(-1, 2)
                pieces = [text[(stop[a - 1] if a and k else start[a]) : stop[b - 1]] for k, (a, b) in enumerate(live)]
                kept.append(b"".join(pieces))
        made = {"text": pa.array(kept, type=pa.binary()).cast(pa.string())}
        return pa.RecordBatch.from_arrays(
            [made.get(c, part.column(c)) for c in names]
            + [
                pa.array(n_words.astype(np.int64)),
                pa.array(n_gone.astype(np.int64)),
                pa.array(spans, type=pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ],
            names=[*names, *made_names],
        )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*names).schema]
    kinds = ("long", "long", "array<struct<first: long, end: long>>")
    return flagged.mapInArrow(cut, ", ".join([*fields, *(f"`{n}` {k}" for n, k in zip(made_names, kinds, strict=True))]))


def op4(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    kept = drop_repeats(docs.select("doc_id", "text"), window=20, joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
