"""A stored registry of text hashes, in versions that hold only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.sources.phases import children

_SCHEMA = "doc_id long, sha string"


class HashRegistry:
    """Hashes by document id under `path`, a folder `version=n` for each version.

    A version has the ids whose hash is new or another than before, and with a null hash those that
    have gone. The state at a version is the newest entry of each id up to it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Finished versions, ascending."""
        named = [c for c in children(self.spark, self.path) if c.startswith("version=")]
        return sorted(int(c.split("=")[1]) for c in named if "_SUCCESS" in children(self.spark, f"{self.path}/{c}"))

    def current(self, version: int | None = None) -> DataFrame:
        """(doc_id, sha, version): the hashes as of `version`, by default the last."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return self.spark.createDataFrame([], _SCHEMA + ", version int")
        parts = [f"{self.path}/version={v}" for v in known]
        rows = self.spark.read.schema(_SCHEMA + ", version int").option("basePath", self.path).parquet(*parts)
        newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "sha")).alias("x"))
        return newest.filter("x.sha IS NOT NULL").select("doc_id", "x.sha", "x.version")

    @staticmethod
    def hashes(docs: DataFrame) -> DataFrame:
        """(doc_id, sha) of `docs` (doc_id, text); of rows that share an id the greatest hash. Rows without an id have none."""
        found = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
        return found.groupBy("doc_id").agg(F.max("sha").alias("sha"))

    def register(self, docs: DataFrame, complete: bool = False) -> int:
        """Write a version of what `docs` change; ids that `docs` don't have stay, or go if `docs` are `complete`.

        Returns the version. Only ids and hashes are joined; a call that changes nothing writes an empty version.
        """
        known = self.versions()
        version = known[-1] + 1 if known else 1
        now, before = self.hashes(docs), self.current().select("doc_id", F.col("sha").alias("old"))
        changed = now.join(before, "doc_id", "full" if complete else "left").filter(~F.col("sha").eqNullSafe(F.col("old")))
        changed.select("doc_id", "sha").write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def flags(self, docs: DataFrame, version: int | None = None) -> DataFrame:
        """(doc_id, tampered): a text's hash isn't the registered one, or its id isn't registered."""
        known = self.current(version).select("doc_id", "sha")
        now = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now"))
        return now.join(known, "doc_id", "left").select("doc_id", (F.col("now") != F.coalesce("sha", F.lit(""))).alias("tampered"))
