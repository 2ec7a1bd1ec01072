"""SentencePiece encoding by a relational lattice, and decoding."""

from __future__ import annotations

import json
import pickle
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.common import Written, bytes_estimate, id_back, id_key, shuffle_partitions, spread, text_slices

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: A word: marks for spaces, then what is up to the next mark. No piece goes over a word's end.
WORD = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
#: Characters of the longest fragment that goes through the lattice as it is.
LONGEST_FRAGMENT = 48
#: Fragments whose ids every task holds, the most frequent ones; all others are joined.
HELD_FRAGMENTS = 3 << 17
#: Bytes of text in a block; a longer text is one of its own.
BLOCK_BYTES = 4 << 20
#: Fragments that one task of the lattice solves, about.
TASK_FRAGMENTS = 40_000
#: Distinct fragments that a worker counts before it hands them on.
_COUNTED = 1 << 17
_UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file: ids and scores by text, the ids of single bytes, the longest piece.

    `within` tells which two characters lie side by side in some piece, by the numbers
    that `number` gives to characters.
    """

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    texts: list[bytes]
    longest: int
    number: np.ndarray
    within: np.ndarray

    @property
    def unknown(self) -> float:
        """The score of a character that is no piece."""
        return min(self.scores.values()) - _UNKNOWN_PENALTY


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, single, texts = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(text[3:5], 16)] = i
            texts.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            ids[text], scores[text] = i, model.get_score(i)
            texts.append(text.replace(SPACE, " ").encode())
    pairs = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
    letters = sorted({c for p in pairs for c in p})
    number = np.zeros(0x110000, dtype=np.int32)  # 0: in no pair
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    within = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
    for a, b in pairs:
        within[number[ord(a)], number[ord(b)]] = True
    return Pieces(ids, scores, single, texts, max(map(len, ids)), number, within)


def normal(text: str | None) -> str:
    """Spaces as marks, one mark in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def fold(word: str, table: Pieces) -> list[int]:
    """The ids of one word: the best path through its lattice, of equal ones the longest last piece."""
    size = len(word)
    best, back = [0.0] + [float("-inf")] * size, [0] * (size + 1)
    for start in range(size):
        for end in range(start + 1, min(size, start + table.longest) + 1):
            score = table.scores.get(word[start:end])
            if score is None and end == start + 1:
                score = table.unknown
            if score is not None and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], size
    while end:
        piece = word[back[end] : end]
        out.append([table.ids[piece]] if piece in table.ids else [table.bytes[b] for b in piece.encode()])
        end = back[end]
    return [i for part in reversed(out) for i in part]


def cut_long(fragment: str, table: Pieces) -> list[str]:
    """A long fragment cut wherever no piece of two characters or more of its lattice lies over the place.

    Every path goes through such a place, so that the best path is that of the parts.
    """
    out, begin, reach = [], 0, 0
    for at in range(len(fragment)):
        if at and reach <= at:
            out.append(fragment[begin:at])
            begin = at
        for end in range(min(len(fragment), at + table.longest), max(at + 1, reach), -1):
            if fragment[at:end] in table.ids:
                reach = end
                break
    return [*out, fragment[begin:]]


def fragments(marked: list[str], table: Pieces) -> tuple[list[str], np.ndarray]:
    """The fragments of all `marked` texts, and where each text's begin in the list (and the last's end).

    A text is cut between any two characters that lie side by side in no piece, which
    includes all ends of words: no piece, hence no edge of a lattice, goes over such a
    place. Fragments over `LONGEST_FRAGMENT` are cut further by `cut_long`.
    """
    whole = "".join(marked)
    ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
    numbers = table.number[np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")]
    cut = np.ones(len(numbers) + 1, dtype=bool)
    if len(numbers):
        cut[1:-1] = ~table.within.ravel()[numbers[:-1] * table.within.shape[1] + numbers[1:]]
    cut[ends] = cut[0] = True
    places = np.flatnonzero(cut)
    starts = np.concatenate([[0], np.searchsorted(places, ends)])
    at = places.tolist()
    found = [whole[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
    sizes = np.diff(places)
    if len(sizes) and sizes.max() > LONGEST_FRAGMENT:
        parts = {int(i): cut_long(found[i], table) for i in np.flatnonzero(sizes > LONGEST_FRAGMENT)}
        more = np.zeros(len(found) + 1, dtype=np.int64)
        for i, part in parts.items():
            more[i + 1] = len(part) - 1
        starts = starts + np.cumsum(more)[starts]
        found = [x for i, f in enumerate(found) for x in parts.get(i, (f,))]
    return found, starts


def chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of `texts`, each chunk of each text as an index to them, and where each text's begin.

    A chunk lies between single spaces; with a mark in front, it is cut into fragments on
    its own. Marks that stand together are in pieces together, so a text that has some
    is one chunk. Null and empty texts have none.
    """
    texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # if_else fails on slices
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))
    if pc.any(odd).as_py():
        texts = pc.if_else(pc.fill_null(odd, False), pc.replace_substring(texts, " ", SPACE), texts)
    lists = pc.split_pattern(pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.large_string()), texts), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Coded:
    """Some texts by their distinct fragments.

    Chunk c is the fragments numbered `code[begin[c]:begin[c + 1]]`; text t is the chunks
    numbered `index[starts[t]:starts[t + 1]]`.
    """

    fragments: pa.Array
    code: np.ndarray
    begin: np.ndarray
    index: np.ndarray
    starts: np.ndarray

    @classmethod
    def make(cls, texts: pa.Array, table: Pieces) -> Coded:
        words, index, starts = chunks(texts)
        found, begin = fragments([SPACE + w for w in words], table)
        coded = pa.array(found, pa.string()).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(), begin, index, starts)

    def pack(self) -> bytes:
        """As bytes: frequent fragments and chunks get small numbers, which go in halves, as these press well."""
        names, code, _ = _by_frequency(self.code, len(self.fragments))
        order, index, _ = _by_frequency(self.index, len(self.begin) - 1)
        sizes = np.diff(self.begin)
        taken = _gather(self.begin[:-1][order], sizes[order])  # the chunks in their new order
        parts = [json.dumps(self.fragments.take(pa.array(names)).to_numpy(zero_copy_only=False).tolist(), ensure_ascii=False).encode()]
        for values in (code[taken], sizes[order], index, np.diff(self.starts)):
            parts += [(values & 0xFFFF).astype("<u2").tobytes(), (values >> 16).astype("<u2").tobytes()]
        return pickle.dumps([zstandard.compress(x) for x in parts])

    @classmethod
    def unpack(cls, raw: bytes) -> Coded:
        names, *halves = [zstandard.decompress(x) for x in pickle.loads(raw)]
        values = [np.frombuffer(lo, "<u2").astype(np.int64) | (np.frombuffer(hi, "<u2").astype(np.int64) << 16) for lo, hi in zip(halves[::2], halves[1::2], strict=True)]
        ends = lambda x: _ends(x).to_numpy()
        return cls(pa.array(json.loads(names), pa.string()), values[0], ends(values[1]), values[2], ends(values[3]))

    def ids(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, from the list of ids of each fragment."""
        sizes = pc.list_value_length(known).to_numpy().astype(np.int64)
        ends = _ends(sizes[self.code]).to_numpy()[self.begin]
        words = pa.LargeListArray.from_arrays(pa.array(ends), pc.list_flatten(known.take(pa.array(self.code))))
        flat = pc.list_flatten(words.take(pa.array(self.index))).to_numpy()
        return flat, _ends(np.diff(ends)[self.index]).to_numpy()[self.starts]


def _by_frequency(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the numbers below `size` by how often they are in `values`, `values` renumbered so, and the new numbers."""
    order = np.argsort(-np.bincount(values, minlength=size), kind="stable")
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.arange(size)
    return order, rank[values], rank


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs of `sizes` from `starts`, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def lattice(words: DataFrame, spark: SparkSession, path: str = MODEL) -> DataFrame:
    """`words` (word, distinct, and other columns) with ids and ends: the best path, its pieces' ids and where they end.

    All substrings of up to the longest piece's length are exploded and joined to the
    piece table by equality (by a hash of 64 bits that tells the table's pieces apart,
    then of the text itself, as a hash of one long is probed five times faster than a
    string); single characters that no piece matches stay as unknown edges, with the id behind the last. The edges of a word are grouped, ordered by end and start, and
    folded by Viterbi's recurrence with a higher-order aggregate; a second one walks
    back. Words are dealt by hash before, so that grouping needs no shuffle of edges.
    """
    table, keys = load(path), words.columns
    listed = spark.createDataFrame(list(table.ids.items()), "text string, id int").withColumn("h", F.xxhash64("text"))
    ends = words.select(*keys, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    spans = ends.select(
        *keys, "end", F.explode(F.sequence(F.greatest(F.col("end") - table.longest, F.lit(0)), F.col("end") - 1)).alias("start")
    )
    cut = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    same = F.col("piece") == F.col("text")
    none = len(table.texts)  # stands for no piece
    # one long an edge, end first, then start, then id: primitive values are sorted faster than structs
    edge = (F.shiftleft(F.col("end").cast("long"), 48) + F.shiftleft(F.col("start").cast("long"), 32) + F.col("id")).alias("edge")
    edges = (
        cut.withColumn("h", F.xxhash64("piece"))
        .join(F.broadcast(listed), "h", "left")
        .select(*keys, "end", "start", F.coalesce(F.when(same, F.col("id")), F.lit(none)).alias("id"))
        .filter((F.col("id") != none) | (F.col("end") == F.col("start") + 1))
        .select(*keys, edge)
    )
    listing = [0.0] * none + [table.unknown]
    for text, i in table.ids.items():
        listing[i] = table.scores[text]
    scores = F.split(F.lit(",".join(map(repr, listing))), ",").cast("array<double>")  # a constant
    parts = F.transform(
        F.sort_array(F.collect_list("edge")),
        lambda e: F.struct(
            F.shiftright(e, 48).cast("int").alias("end"),
            F.shiftright(e, 32).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("start"),
            F.get(scores, e.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("score"),
            e.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("id"),
        ),
    )
    grouped = edges.groupBy(*keys).agg(parts.alias("edges"))
    step = "struct<score: double, start: int, id: int>"
    # best[e] is the best way to end e; edges come by end, so that their starts are settled
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-2).alias("id")).cast(step))

    def settle(best: Column, e: Column) -> Column:
        score = F.get(best, e.start).score + e.score
        here = F.struct(score.alias("score"), e.start.alias("start"), e.id.alias("id"))
        return (
            F.when(F.size(best) <= e.end, F.array_append(best, here))
            .when(score > F.get(best, e.end).score, F.array_append(F.slice(best, F.lit(1), e.end), here))
            .otherwise(best)
        )

    def walk(acc: Column, _: Column) -> Column:
        top = F.get(F.col("best"), acc.end)
        return F.when(acc.end <= 0, acc).otherwise(
            F.struct(
                top.start.alias("end"),
                F.array_prepend(acc.ids, top.id).alias("ids"),
                F.array_prepend(acc.ends, acc.end).alias("ends"),
            )
        )

    solved = grouped.select(*keys, F.aggregate("edges", begin, settle).alias("best"))
    empty = F.array().cast("array<int>")
    back = F.aggregate(
        F.sequence(F.lit(1), F.size("best") - 1),
        F.struct((F.size("best") - 1).alias("end"), empty.alias("ids"), empty.alias("ends")),
        walk,
    )
    return solved.select(*keys, back.alias("path")).select(*keys, "path.ids", "path.ends")


def counted(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(word, n): the distinct fragments of the texts of `docs` that the lattice solves, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = load(path), {}
        get = seen.get

        def rows() -> pa.RecordBatch:
            words, counts = list(seen), list(seen.values())
            sums: dict[str, int] = {}
            total = sums.get
            for begin in range(0, len(words), _COUNTED):
                found, starts = fragments([SPACE + w for w in words[begin : begin + _COUNTED]], table)
                times = np.repeat(counts[begin : begin + _COUNTED], np.diff(starts)).tolist()
                for f, n in zip(found, times, strict=True):
                    sums[f] = total(f, 0) + n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in text_slices(batch, limit=BLOCK_BYTES):
                words, index, _ = chunks(part.column("text"))
                for word, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
                    seen[word] = get(word, 0) + n
                if len(seen) > _COUNTED:
                    yield rows()
        yield rows()

    made = docs.select("text").mapInArrow(run, "word string, n long").filter(F.length("word") <= LONGEST_FRAGMENT)
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def solve(words: DataFrame, path: str = MODEL) -> DataFrame:
    """(word, n, ids) for the distinct rows of `words` (word, n); characters that are no piece become the pieces of their bytes."""
    spark, table = words.sparkSession, load(path)
    count, none = words.count(), len(table.texts)
    dealt = words.select("word", "n").repartition(max(shuffle_partitions(spark), -(-count // TASK_FRAGMENTS)), "word")
    single = F.split(F.lit(",".join(map(str, table.bytes))), ",").cast("array<int>")  # a constant

    def spelled(end: Column) -> Column:
        code = F.hex(F.encode(F.substring(F.col("word"), end, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.get(single, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int"))
        )

    each = F.zip_with("ids", "ends", lambda i, end: F.when(i == none, spelled(end)).otherwise(F.array(i)))
    return lattice(dealt, spark, path).select(
        "word", "n", F.when(F.array_contains("ids", none), F.flatten(each)).otherwise(F.col("ids")).cast(f"array<{_width(table)}>").alias("ids")
    )


def _width(table: Pieces) -> str:
    """The type that shuffled ids take."""
    return "smallint" if len(table.texts) < 1 << 15 else "int"


def _frequent(words: DataFrame, most: int) -> int:
    """The least n such that no more than `most` rows of `words` (word, n) have it or more."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(bucket.alias("b")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("b")).collect()  # some hundreds
    total, least = 0, 1 << 62
    for row in sizes:
        total += row.rows
        if total > most:
            break
        least = row.n
    return least


def known_ids(found: pa.Array, table: Pieces, held: pa.Table, rare: pa.Table) -> pa.Array:
    """The list of ids of each fragment, from `held` or `rare` (word, ids).

    One over the lattice's length is folded by the same recurrence; a missing one is an error.
    """
    at = pc.index_in(found, held.column("word"))
    open_ = at.is_null()
    others = found.filter(open_)
    sources, place = [*held.column("ids").chunks], at.to_numpy(zero_copy_only=False).copy()
    if len(others):
        long = pc.greater(pc.utf8_length(others), LONGEST_FRAGMENT)
        folded = [fold(f, table) for f in others.filter(long).to_pylist()]
        where = pc.index_in(others, rare.column("word")).to_numpy(zero_copy_only=False).astype(np.float64) + held.num_rows
        longs = long.to_numpy(zero_copy_only=False)
        where[longs] = held.num_rows + rare.num_rows + np.arange(len(folded))
        if np.isnan(where).any():
            raise KeyError(f"fragments without ids: {others.filter(pa.array(np.isnan(where)))[:3]}")
        place[open_.to_numpy(zero_copy_only=False)] = where
        sources += [*rare.column("ids").chunks, pa.array(folded, pa.list_(pa.int32()))]
    sources = [x.cast(pa.large_list(pa.int32())) for x in sources] or [pa.array([], pa.large_list(pa.int32()))]
    return pa.concat_arrays(sources).take(pa.array(place.astype(np.int64)))


_WORDS = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])
_held: dict[int, pa.Table] = {}


def _known(sent) -> pa.Table:
    """The broadcast fragments, read once in a worker."""
    if sent.id not in _held:
        _held.clear()
        _held[sent.id] = pa.ipc.open_stream(sent.value).read_all()
    return _held[sent.id]


class _Sent:
    """A broadcast value with a number that workers know it by."""

    def __init__(self, spark: SparkSession, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self._value = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        self.id = self._value._jbroadcast.id()

    @property
    def value(self) -> bytes:
        return self._value.value

    def __getstate__(self):
        return {"_value": self._value, "id": self.id}


def _texts(flat: pa.Array, ends: np.ndarray, path: str) -> pa.Array:
    """The texts that the ids between each two `ends` say, without the space in front."""
    taken = pa.array(load(path).texts, pa.large_binary()).take(flat)
    marks = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(taken.buffers()[2], dtype=np.uint8)[: marks[-1]] if len(taken) else np.zeros(0, dtype=np.uint8)
    at = marks[ends]
    first = at[:-1][at[1:] > at[:-1]]
    first = first[data[first] == 0x20]
    keep = np.ones(len(data), dtype=bool)
    keep[first] = False
    gone = np.searchsorted(first, at)
    data, at = data[keep], at - gone
    out = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        out.validate(full=True)
        return out.cast(pa.string())
    except pa.ArrowInvalid:  # ids of lone bytes
        return pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(at, at[1:])], pa.string())  # noqa: B905


def _rows(keys: pa.Array, flat: np.ndarray, ends: np.ndarray, back: str | None = None) -> pa.RecordBatch:
    ids, raw, at = pa.array(flat, pa.int32()), memoryview(np.ascontiguousarray(flat, dtype="<i4")).cast("B"), (4 * ends).tolist()
    crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())  # noqa: B905
    columns = [keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids), crc]
    if back:
        columns.append(_texts(ids, ends, back))
    return pa.RecordBatch.from_arrays(columns, names=["key", "ids", "ids_crc32", "text"][: len(columns)])


_SCHEMA = "key long, ids array<int>, ids_crc32 long"


def encode(
    docs: DataFrame, path: str = MODEL, held: int = HELD_FRAGMENTS, block_bytes: int = BLOCK_BYTES, decoded: bool = False
) -> DataFrame:
    """(key, ids, ids_crc32): the piece ids of each text, as a unigram model with the file's scores gives them.

    One row for each row of `docs` (doc_id, text), repeated ids and texts included; an
    empty table gives none. Whole texts; a null text is empty and has no ids. `decoded`:
    with `text` too, decoded from the ids by the worker that made them.

    Texts are cut into fragments that no piece goes over. The corpus's distinct
    fragments go through the lattice once. The `held` most frequent ones are sent to all
    tasks; texts go once through a shuffle, in blocks of up to `block_bytes` coded by
    their distinct fragments and compressed, and meet the ids of their block's other
    fragments, which are joined by the fragment. A corpus without others isn't shuffled. What is still longer than `LONGEST_FRAGMENT`
    where pieces overlap without end (a run of one letter, say) is no row of the lattice:
    the worker that puts the text together folds it by the same recurrence, in space and
    time linear in its length.
    """
    spark, back = docs.sparkSession, path if decoded else None
    schema = _SCHEMA + ", text string" * decoded
    keyed = spread(docs.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    words = Written(counted(keyed, path), "fragments")
    least = _frequent(words.df, held)
    solved = Written(solve(words.df, path), "solved")
    words.drop()
    often = solved.df.filter(F.col("n") >= least).drop("n")
    sent = _Sent(spark, often.toArrow())  # `held` rows at most

    if least <= 1:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, held = load(path), _known(sent)
            for batch in batches:
                for part in text_slices(batch, limit=block_bytes):
                    coded = Coded.make(part.column("text"), table)
                    yield _rows(part.column("key"), *coded.ids(known_ids(coded.fragments, table, held, _WORDS.empty_table())), back)

        return keyed.mapInArrow(whole, schema)

    total = bytes_estimate(keyed, "text")
    blocks = max(1, -(-total // block_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path)
        for batch in batches:
            for part in text_slices(batch, limit=block_bytes):
                row = pickle.dumps((part.column("key").to_numpy(), Coded.make(part.column("text"), table).pack()))
                number = xxhash.xxh64_intdigest(row) % (8 * blocks)  # small, so that it presses well; blocks may share one
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([row], pa.binary())], names=["block", "row"])

    # a block is one column, so that both uses below read the same shuffle
    dealt = keyed.mapInArrow(deal, "block long, row binary").repartition(blocks, "block")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _known(sent)
        for batch in batches:
            for block, row in zip(batch.column("block"), batch.column("row"), strict=True):
                found = Coded.unpack(pickle.loads(row.as_py())[1]).fragments
                few = found.filter(pc.and_(pc.index_in(found, held.column("word")).is_null(), pc.less_equal(pc.utf8_length(found), LONGEST_FRAGMENT)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), block.as_py())), few], names=["of", "word"])

    needed = dealt.mapInArrow(rare, "of long, word string").join(solved.df.filter(F.col("n") < least).drop("n"), "word")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        table, held, made = load(path), _known(sent), []
        for row in left.column("row"):
            keys, raw = pickle.loads(row.as_py())
            coded = Coded.unpack(raw)
            made.append(_rows(pa.array(keys), *coded.ids(known_ids(coded.fragments, table, held, right)), back))
        none = np.zeros(1, dtype=np.int64)
        return pa.Table.from_batches(made, schema=_rows(pa.array([], pa.int64()), none[:0].astype("<i4"), none, back).schema)

    return dealt.groupBy("block").cogroup(needed.groupBy("of")).applyInArrow(build, schema)


def decode(rows: DataFrame, path: str = MODEL, column: str = "ids") -> DataFrame:
    """`rows` with `text`: what the piece ids of `column` say; unknown and control ids give nothing.

    Ids outside the file's range are an error. Null ids give a null text.
    """
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(column)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            found = _texts(pc.list_flatten(ids), np.cumsum(np.concatenate([[0], sizes])), path)
            made = pc.if_else(ids.is_valid(), found, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema]
    return rows.select(*names).mapInArrow(run, ", ".join([*fields, "text string"]))


def op8(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256."""
    found = encode(docs.select("doc_id", "text"), decoded=True)
    return found.select(
        id_back(F.col("key")).alias("doc_id"),
        F.size("ids").cast("long").alias("n_ids"),
        "ids_crc32",
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
