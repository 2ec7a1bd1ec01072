"""Vectors stored as blocks of matrices in cells, so that a search visits only the cells that can hold a neighbour."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.operators.arrays import matrix
from tessaline.sources.shared import new_path

#: Vectors in a block; a task compares two blocks at a time.
BLOCK = 1024
#: Vectors that one bucket of the stored table holds, about, and the least for small tables.
BUCKET, LEAST_BUCKET = 8192, 256
#: Buckets of whole cells at most, as the driver has a number for each; from 500 million vectors on buckets grow.
MOST_BUCKETS = 65_536
#: Vectors to a cell, about, and cells at most: their centres are sent to every task.
CELL, MOST_CELLS = 16_384, 4096

_BLOCK_SCHEMA = "bucket int, cell int, n int, ids binary, m binary"


def _table_name(path: str) -> str:
    return "blocks_" + hashlib.sha256(path.encode()).hexdigest()[:24]


@dataclass
class Cells:
    """A stored table of blocks: bucket, cell, n, ids and m (n vectors of doubles, row by row).

    A cell is cut into as many buckets as its vectors need; a bucket is of one cell. The
    table is bucketed by `bucket`, so that joins by it don't shuffle it. `centres` has a
    row a cell, `radii` the greatest distance of its vectors from it, `of_bucket` the cell of each bucket; `total` is the number of vectors.
    """

    path: str
    centres: np.ndarray
    radii: np.ndarray
    of_bucket: np.ndarray
    total: int

    @property
    def buckets(self) -> int:
        return len(self.of_bucket)

    def read(self, spark: SparkSession) -> DataFrame:
        name = _table_name(self.path)
        if not spark.catalog.tableExists(name):
            place = self.path.replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {name} ({_BLOCK_SCHEMA}) USING parquet CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{place}/blocks'"
            )
        return spark.table(name)


def open_cells(spark: SparkSession, path: str) -> Cells:
    """The cells written at `path`."""
    row = spark.read.schema("facts string").json(f"{path}/facts").first()
    facts = json.loads(row.facts)
    centres = np.array(facts["centres"], dtype=np.float64).reshape(len(facts["radii"]), -1)
    of_bucket = np.array(facts["of_bucket"], dtype=np.int64)
    return Cells(path, centres, np.array(facts["radii"]), of_bucket, facts.get("total", BUCKET * len(of_bucket)))


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row (of the nearest centre) and the distance from its centre."""
    far = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T
    cell = far.argmin(axis=1)
    step = rows - centres[cell]
    return cell, np.sqrt((step * step).sum(axis=1))


def spread_out(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` different ones of `rows`, each the farthest from those before it."""
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < count:
        step = rows - rows[chosen[-1]]
        far = np.minimum(far, (step * step).sum(axis=1))
        after = int(far.argmax())
        if far[after] == 0:
            break
        chosen.append(after)
    return rows[chosen]


def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, cell, far)."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest_centre(matrix(batch.column("v")), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, cell int, far double")


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:], strict=False):
            for begin in range(first, last, BLOCK):
                part = batch.slice(begin, min(BLOCK, last - begin))
                arrays = [part.column("bucket")[:1], part.column("cell")[:1], pa.array([part.num_rows], pa.int32())]
                arrays += [pa.array([part.column("id").to_numpy().astype("<i8").tobytes()]), pa.array([matrix(part.column("v")).astype("<f8").tobytes()])]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "cell", "n", "ids", "m"])


def write_cells(rows: DataFrame, path: str | None = None, cells: int | None = None, like: Cells | None = None) -> Cells:
    """Store `rows` (id long, v: arrays of one length, both never null) as blocks, at `path` or a new one.

    Centres are chosen far from each other out of four times as many vectors, picked by a
    hash of the id, so that cells are small: as many as give cells of about `CELL` vectors
    (or `cells`), `MOST_CELLS` at most, or those of `like`. Cells with many
    vectors, of copies for example, are cut by a hash of the id into buckets.
    """
    spark = rows.sparkSession
    total = rows.count()
    cores = spark.sparkContext.defaultParallelism
    if like is not None:
        centres = like.centres
    else:
        wanted = max(1, min(MOST_CELLS, cells or total // CELL, total))
        if wanted > 1:
            least = [r.v for r in rows.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(4 * wanted).collect()]
            centres = spread_out(np.array(least, dtype=np.float64), wanted)
        else:
            first = rows.select("v").first()
            centres = np.zeros((1, len(first.v) if first else 0))
    if len(centres) > 1 or like is not None:
        placed = _assign(rows, centres)
        facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a cell
        sizes = {r.cell: (r.n, r.far) for r in facts}
    else:
        placed, sizes = rows.select("id", "v", F.lit(0).alias("cell")), {0: (total, np.inf)}
    each = max(LEAST_BUCKET, min(BUCKET, total // (4 * cores)), total // MOST_BUCKETS)
    shares = [max(1, -(-sizes.get(c, (0, 0.0))[0] // each)) for c in range(len(centres))]
    bases = np.cumsum([0, *shares[:-1]])
    radii = np.array([sizes.get(c, (0, -1.0))[1] for c in range(len(centres))])
    made = Cells(path or new_path(spark), centres, radii, np.repeat(np.arange(len(centres)), shares), total)
    table = spark.createDataFrame([(c, int(b), s) for c, (b, s) in enumerate(zip(bases, shares, strict=True))], "cell int, base int, share int")
    numbered = placed.join(F.broadcast(table), "cell").select(  # a row a cell
        (F.col("base") + F.pmod(F.xxhash64("id"), F.col("share"))).cast("int").alias("bucket"), "cell", "id", "v"
    )
    blocks = numbered.repartition(made.buckets, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(_to_blocks, _BLOCK_SCHEMA)
    name = "new_" + _table_name(made.path)
    blocks.write.bucketBy(made.buckets, "bucket").option("path", f"{made.path}/blocks").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: their place was given
    if path:  # to be opened again
        known = {"centres": made.centres.tolist(), "radii": made.radii.tolist(), "of_bucket": made.of_bucket.tolist(), "total": total}
        spark.createDataFrame([(json.dumps(known),)], "facts string").coalesce(1).write.json(f"{path}/facts")
    return made
