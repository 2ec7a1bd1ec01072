"""Copies by the similarity of their word shingles.

SimHash fingerprints propose groups; MinHash bands add the pairs whose similarity 64 bits don't show; exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Written, id_key, join_hash, join_unequal, shuffle_partitions, spread, text_slices
from tessaline.llm.components import connected_components
from tessaline.llm.simhash import UNIT, links_between, simhash_bytes, stars

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.999997 at 0.8.
BANDS, ROWS = 32, 5
#: Bits that fingerprints of one SimHash group differ in, from link to link.
BITS = 4
#: Bytes of text taken apart at once.
_PART = 1 << 20
#: Shingles hashed at once; bounds memory for very long texts.
_CHUNK = 1 << 12
#: Shingles that one matrix product covers.
_COLUMNS = 1 << 12
#: Shingles of a part of a group; bounds a unit's memory where texts are long.
_UNIT_SHINGLES = 1 << 20
#: Names that no input column is expected to have.
_KEY, _CLASS, _PRINT, _BANDS, _ORDER = (f"__tessaline_{n}" for n in ("key", "class", "print", "bands", "order"))
_TURNS = np.random.default_rng(31).integers(0, 2**64, size=(2, BANDS * ROWS), dtype=np.uint64, endpoint=False)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def shingles(words: list[bytes], length: int) -> np.ndarray:
    """The distinct XXH64 of all runs of `length` words, sorted; of all words, if they are fewer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k, digest = min(length, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)), dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One value for each band of MinHashes of the shingles; none without shingles."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, ((found[at : at + _CHUNK, None] ^ _TURNS[0]) * (_TURNS[1] | np.uint64(1))).min(axis=0))
    value = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        value = join_hash(value, row)
    return value


def shared_counts(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles each two of several sets share; the sets lie one behind the other in `found`.

    Counted as a matrix product over `_COLUMNS` shingles at a time, exactly.
    """
    both = np.zeros((len(sizes), len(sizes)), dtype=np.int32)
    _, at, times = np.unique(found, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # a shingle of one set is shared by none
    owner = np.repeat(np.arange(len(sizes)), sizes)[times[at] > 1]
    column = number[at[times[at] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + _COLUMNS])
        has = np.zeros((len(sizes), _COLUMNS), dtype=np.float32)
        has[owner[lo:hi], column[lo:hi] - begin] = 1
        both += (has @ has.T).astype(np.int32)
    return both


def links_of(found: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets of Jaccard similarity `least` or more, within side 1 or from side 0 to side 2."""
    both = shared_counts(found, sizes)
    near = both >= least * (sizes[:, None] + sizes[None, :] - both)
    near &= ((side[:, None] == 1) & (side[None, :] == 1)) | (side[:, None] != side[None, :])
    return np.nonzero(np.triu(near, 1))


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """`docs` (with text) and, for each row, its key, `c`, a 128-bit hash of the words that exact copies share, SimHash and bands."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=_PART):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                words = [split(t) for t in texts]
                prints = np.array([simhash_bytes(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
                classes = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                values = [bands(shingles(w, shingle)).view(np.int64) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(classes, pa.binary()), pa.array(prints), pa.array(values, pa.list_(pa.int64()))],
                    names=[*names, _KEY, _CLASS, _PRINT, _BANDS],
                )

    rows = spread(docs.withColumn(_KEY, id_key()))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([*fields, f"{_CLASS} binary, {_PRINT} long, {_BANDS} array<long>"]))


def _links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b), by class, of the pairs of classes within a group (hub, c) whose similarity is `least` or more.

    As stars, which connect the same classes. Groups over `UNIT` members or
    `_UNIT_SHINGLES` shingles are cut into parts by a hash, each pair of parts is a unit
    of its own, so that no task holds a whole group.
    """
    joined = members.join(sets, "c").select("hub", "c", "s")
    totals = members.join(sets.select("c", F.size("s").alias("m")), "c").groupBy("hub").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    parts = F.ceil(F.greatest(F.col("n") / F.lit(UNIT), F.col("m") / F.lit(_UNIT_SHINGLES))).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("p") - 1),
        lambda j: F.struct(
            F.least(j, F.col("k")).alias("i"),
            F.greatest(j, F.col("k")).alias("j"),
            F.when(j == F.col("k"), 1).when(j > F.col("k"), 0).otherwise(2).alias("side"),
        ),
    )
    units = (
        join_unequal(joined, totals.select("hub", "n", parts.alias("p")), ["hub"], members.count())
        .withColumn("k", F.pmod(F.xxhash64("c"), F.col("p")).cast("int"))
        .select("hub", "c", "s", F.explode(others).alias("o"))
        .select(F.xxhash64("hub", "o.i", "o.j").alias("u"), F.col("o.side").cast("int").alias("side"), "hub", "o.i", "o.j", "c", "s")
        .repartition(shuffle_partitions(members.sparkSession), "u")
        .sortWithinPartitions("u", "hub", "i", "j", "side")
        .select("hub", "i", "j", "side", "c", "s")
    )

    def solve(held: list[tuple]) -> pa.RecordBatch:
        side = np.array([r[0] for r in held], dtype=np.int64)
        names = np.array([r[1] for r in held], dtype=object)
        order = np.argsort(names, kind="stable")
        rank = np.empty(len(held), dtype=np.int64)  # the classes' order, as numbers
        rank[order] = np.arange(len(held))
        a, b = links_of(np.concatenate([r[2] for r in held]), np.array([len(r[2]) for r in held]), side, least)
        far, near = stars(a, b, rank) if len(a) else (rank[:0], rank[:0])
        by_rank = names[order]
        return pa.RecordBatch.from_arrays([pa.array(by_rank[far], pa.binary()), pa.array(by_rank[near], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            names = zip(*(batch.column(n).to_pylist() for n in ("hub", "i", "j")), strict=True)
            side, names_c = batch.column("side").to_numpy(), batch.column("c").to_pylist()
            lists = batch.column("s")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for row, unit in enumerate(names):
                if unit != last and held:
                    yield solve(held)
                    held = []
                last = unit
                held.append((side[row], names_c[row], values[ends[row] : ends[row + 1]].copy()))
        if held:
            yield solve(held)

    return units.mapInArrow(run, "a binary, b binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(c, s) for (c, text): the distinct shingles of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=_PART):
                found = [shingles(split(t), shingle).view(np.int64) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(found, pa.list_(pa.int64()))], names=["c", "s"])

    return texts.select("c", "text").mapInArrow(run, "c binary, s array<long>")


def _near_prints(classes: DataFrame) -> DataFrame:
    """(hub, c) for `classes` (c, fp): the groups of more than one whose fingerprints are linked at `BITS` or fewer bits."""
    prints = Written(classes.groupBy("fp").agg(F.count("*").alias("n")), "prints").df
    components = connected_components(links_between(prints.select(F.col("fp").alias("rep"), "fp"), BITS))
    rooted = prints.join(components, F.col("fp") == F.col("vertex"), "left").select("fp", "n", F.coalesce("component", "fp").alias("root"))
    several = rooted.groupBy("root").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("root")
    labels = Written(rooted.join(several, "root").select("fp", "n", "root"), "roots").df
    found = join_unequal(classes.select("c", "fp"), labels, ["fp"], classes.count())
    return found.select(F.unhex(F.lpad(F.hex("root"), 16, "0")).alias("hub"), "c")


def _shared_bands(classes: DataFrame) -> DataFrame:
    """(hub, c) for `classes` (c, bands) that share a band.

    Members of a bucket go to the group of its hub, the member that meets most others,
    so that the many buckets of one large group of copies are settled once.
    """
    keyed = classes.select("c", F.explode("bands").alias("v"))
    sizes = keyed.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
    met = Written(keyed.join(sizes, "v"), "met").df
    degrees = met.groupBy("c").agg(F.sum("n").alias("d"))
    hubs = met.join(degrees, "c").groupBy("v").agg(F.max(F.struct("d", "c")).alias("h")).select("v", F.col("h.c").alias("hub"))
    return met.join(hubs, "v").select("hub", "c").distinct()


def _groups(prints: DataFrame, shingle: int, least: float, wider: bool) -> tuple[DataFrame, DataFrame]:
    """(c, rep, n) of the classes of `prints`, and (vertex, component) of those that have a link, by class."""
    named = prints.select(F.col(_KEY).alias("key"), F.col(_CLASS).alias("c"), F.col(_PRINT).alias("fp"), F.col(_BANDS).alias("bands"), "text")
    first = [F.first(c).alias(c) for c in ("fp", "bands")]
    classes = Written(named.groupBy("c").agg(F.min("key").alias("rep"), *first, F.count("*").alias("n")), "classes").df
    near = _near_prints(classes.select("c", "fp"))
    members = Written(near.unionByName(_shared_bands(classes.select("c", "bands"))) if wider else near, "members").df
    # one text a class: by key and class, as a class can have a third of all rows
    needed = classes.join(members.select("c").distinct(), "c", "left_semi").select(F.col("rep").alias("key"), "c")
    texts = named.select("key", "c", "text").join(needed, ["key", "c"], "left_semi").groupBy("c").agg(F.first("text").alias("text"))
    sets = Written(_sets(texts, shingle), "sets").df
    return classes.select("c", "rep", "n"), connected_components(_links(members, sets, least))


def copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, wider: bool = True) -> DataFrame:
    """Group the rows of `docs` whose texts are copies, directly or over others.

    Two texts are linked if the Jaccard similarity of their shingles is `least` or more;
    each link is verified on the whole texts. SimHash groups the texts whose fingerprints
    are linked at `BITS` or fewer bits, and all pairs of a group are looked at; where
    `wider`, those that share MinHash bands too, which a pair of similarity 0.8 does with
    probability 0.999997, as most such pairs are further apart in 64 bits. Returns (key, c,
    component), one row for each input row: `id_key` of the id, the hash of its words,
    and the smallest key among the rows of its group. Texts with the same words are one
    class (those without a word among them). Rows that repeat an id, or have none, are
    grouped by their own texts only. An empty table gives no row.
    """
    prints = Written(_prints(docs.select("doc_id", F.col("text").cast("string").alias("text")), shingle), "prints").df
    classes, components = _groups(prints, shingle, least, wider)
    rooted = classes.join(components, F.col("c") == F.col("vertex"), "left").withColumn("root", F.coalesce("component", "c"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    labels = Written(rooted.select("c", "n", "root").join(smallest, "root").select("c", "n", "component"), "labels").df
    rows = prints.select(F.col(_KEY).alias("key"), F.col(_CLASS).alias("c"))
    return join_unequal(rows, labels, ["c"], rows.count())


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, wider: bool = True) -> DataFrame:
    """The documents without copies: of each group as `copies` finds them the row with the smallest id stays.

    A null id sorts first. Of several rows with that id, the one whose words have the
    least hash stays; of those with the same words, the one whose whole row has the least
    hash. Rows that merely share an id, or have none, stay if their texts differ. Columns
    are unchanged, whatever their names.
    """
    prints = Written(_prints(docs.withColumn("text", F.col("text").cast("string")), shingle), "prints").df
    classes, components = _groups(prints, shingle, least, wider)
    rooted = classes.join(components, F.col("c") == F.col("vertex"), "left").withColumn("root", F.coalesce("component", "c"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("rep", "c")).alias("x")).select(F.col("x.rep").alias(_KEY), F.col("x.c").alias(_CLASS))
    # rows are joined by id and class together, so that neither a hot text nor a hot id meets in one task; rows equal
    # in both combine before the shuffle
    others = [F.col(f"`{c}`") for c in docs.columns]
    one = prints.groupBy(_KEY, _CLASS).agg(F.min_by(F.struct(*others), F.xxhash64(F.to_json(F.struct(*others)))).alias(_ORDER))
    return one.join(stay, [_KEY, _CLASS], "left_semi").select(f"{_ORDER}.*")
