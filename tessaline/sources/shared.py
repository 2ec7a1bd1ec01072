"""Tables written to the folder that driver and executors share, to cut the lineage behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of this machine only on a local master, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessaline-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: What `stored` has written and nothing has deleted yet.
_STORED: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/tessaline-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> int:
    """Delete what `stored` has written so far; frames that read it can't be used any more. Returns how many tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _STORED:
        place = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        gone += place.getFileSystem(conf).delete(place, True)
    return gone


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read again; `release` deletes it."""
    path = new_path(df.sparkSession)
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
