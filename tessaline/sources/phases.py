"""Results of phases kept in the shared folder, so that a run that is started again goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaline.sources.shared import new_path, shared_folder

#: One for each place: threads of a driver that want the same phase make it once.
_LOCKS: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
#: Part of every key; to be raised when a phase works out something else than before.
EDITION = 3
MANIFEST_SCHEMA = "name string, key string, settings string, inputs string, seconds double"


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none where there is no folder."""
    place, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files behind `paths`: places, lengths and times of change. Other files, another digest."""
    facts = []
    for path in sorted(paths):
        place, files = _files(spark, path)
        if files.exists(place):
            facts += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(place))
        else:
            facts.append((path, -1, -1))
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()


class Phases:
    """Phases by name, inputs and settings. What is there isn't worked out again; `reset` takes it away.

    A phase is written beside its place and then moved there with its entry of the manifest, so that one that
    was cut off isn't taken for finished.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """`folder`, or the one named in the session's `spark.tessaline.phases`, outlives the application; else one of its own is taken."""
        named = folder or spark.conf.get("spark.tessaline.phases", None)
        self.spark, self.folder = spark, named or f"{shared_folder(spark)}/tessaline-phases-{spark.sparkContext.applicationId}"

    def _key(self, inputs: list[str], settings: dict) -> tuple[str, str, str]:
        of_files, said = fingerprint(self.spark, inputs), json.dumps(settings, sort_keys=True)
        return hashlib.sha256(f"{EDITION}:{of_files}:{said}".encode()).hexdigest()[:24], of_files, said

    def done(self, name: str, inputs: list[str], settings: dict) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/{self._key(inputs, settings)[0]}")

    def get(self, name: str, inputs: list[str], settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The phase's rows; `make` works them out where they aren't there."""
        key, of_files, said = self._key(inputs, settings)
        path = f"{self.folder}/{name}/{key}"
        with _LOCKS[path]:
            if not exists(self.spark, path):
                began, beside = time.time(), new_path(self.spark)
                make().write.parquet(f"{beside}/rows")
                entry = [(name, key, said, of_files, time.time() - began)]
                self.spark.createDataFrame(entry, MANIFEST_SCHEMA).coalesce(1).write.json(f"{beside}/about")
                place, files = _files(self.spark, path)
                files.mkdirs(place.getParent())
                if not files.rename(_files(self.spark, beside)[0], place):
                    raise OSError(f"{beside} can't be moved to {path}")
        return self.spark.read.parquet(f"{path}/rows")

    def manifest(self) -> DataFrame:
        """(name, key, settings, inputs, seconds) of each finished phase."""
        names = children(self.spark, self.folder)
        there = [f"{self.folder}/{n}/{k}/about" for n in names for k in children(self.spark, f"{self.folder}/{n}")]
        there = [p for p in there if exists(self.spark, p)]
        return self.spark.read.schema(MANIFEST_SCHEMA).json(there) if there else self.spark.createDataFrame([], MANIFEST_SCHEMA)

    def reset(self, *names: str) -> None:
        """Forget the phases of these names; all of them if none is named."""
        for name in names or children(self.spark, self.folder):
            delete(self.spark, f"{self.folder}/{name}")
