"""Encoders of texts, and the loop that perturbs texts until their coherence falls."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.functions import text as T
from tessaline.functions import vectors as V
from tessaline.operators import generate
from tessaline.operators.arrays import array_column
from tessaline.operators.neighbours import coherence, top_k
from tessaline.sources.phases import exists
from tessaline.sources.shared import new_path, stored

#: Texts that an encoder gets at once.
BATCH = 32
_VECTORS = "sha string, v array<double>"


class Encoder(Protocol):
    """Makes a row of `size` doubles of each text."""

    size: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Counts of lower-cased words by crc32, as unit vectors (zero without a word): a stand-in for a neural encoder."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                out[i, zlib.crc32(word.encode()) % self.size] += 1
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms > 0, norms, 1)


def encode_with(docs: DataFrame, encoder: Encoder, store: str | None = None, batch: int = BATCH) -> DataFrame:
    """(id, v) of `docs` (id, text; a null text is empty), a row for each of theirs.

    Each different text is encoded once, told by its SHA-256: new ones are written to
    `store` (or a folder of their own), and those that a former call wrote there are read.
    Only hashes, ids and vectors are joined; a store is of one encoder.
    """
    spark, path = docs.sparkSession, store or new_path(docs.sparkSession)
    hashed = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    known = spark.read.schema(_VECTORS).parquet(path) if exists(spark, path) else spark.createDataFrame([], _VECTORS)
    new = hashed.select("sha", "text").join(known.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(encoder))  # the model goes to each executor once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(sent.value)
        for rows in batches:
            for begin in range(0, rows.num_rows, batch):
                part = rows.slice(begin, batch)
                made = np.ascontiguousarray(model(part.column("text").to_pylist()), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([part.column("sha"), array_column(made)], names=["sha", "v"])

    new.mapInArrow(run, _VECTORS).write.mode("append").parquet(path)
    return hashed.select("id", "sha").join(spark.read.schema(_VECTORS).parquet(path).dropDuplicates(["sha"]), "sha").select("id", "v")


def encode(docs: DataFrame, size: int = 256, id_column: str = "doc_id") -> DataFrame:
    """(id, v): hashed word counts as a unit vector, without Python."""
    words = docs.select(F.col(id_column).alias("id"), T.words(F.col("text")).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(words)
    return counted.select("id", V.unit(vector_to_array("tf")).alias("v"))


def perturb_until_apart(docs: DataFrame, limit: float = 0.85, rounds: int = 3, k: int = 5) -> DataFrame:
    """(doc_id, text, rounds, cluster_coh): texts in too coherent neighbourhoods are perturbed, `rounds` times at most.

    Each round encodes, measures the coherence of the k nearest of every document,
    perturbs those over `limit` (synonyms, sentence order, dropped words) and leaves the
    rest; it ends early when none is over.
    """
    now = docs.select("doc_id", "text", F.lit(0).alias("rounds"))
    for turn in range(rounds + 1):
        vectors = stored(encode(now))
        measured = coherence(top_k(vectors, vectors, k), vectors).withColumnRenamed("query_id", "doc_id")
        now = stored(now.join(measured, "doc_id"))
        hot = now.filter(F.col("cluster_coh") > limit)
        if turn == rounds or hot.isEmpty():
            return now
        changed = generate.drop_tokens(generate.shuffle_sentences(generate.swap_synonyms(hot, turn), turn), turn)
        changed = changed.join(hot.select("doc_id", (F.col("rounds") + 1).alias("rounds")), "doc_id")
        now = now.filter(F.col("cluster_coh") <= limit).select("doc_id", "text", "rounds").unionByName(changed)
    return now
