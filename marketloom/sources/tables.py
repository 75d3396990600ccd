"""A table of buckets with a manifest: a change rewrites the buckets that it touches and then swaps the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Rows keyed by `keys` in `buckets` folders below `path`, by hash of the keys.

    Version n is the file manifest/n.json, which names a folder for each bucket that has rows; it is written under another name and renamed, so a reader sees a whole
    version or none. A change that is applied again under its number starts from the version before it and leaves the same table. Folders that neither
    the newest version nor the one before it names are deleted, so a reader of the last version can finish. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._files = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._Path(f"{self.path}/manifest")
        if not self._files.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None) -> dict[str, str]:
        """Bucket to folder, relative to the path."""
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The newest version or a given one. Without any version the schema says what an empty table has."""
        known = self.versions()
        folders = self.manifest(version if version is not None else known[-1] if known else None)
        if not folders:
            if schema is None:
                raise ValueError("the table has no rows; name a schema")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in sorted(set(folders.values()))])

    def apply(self, change: DataFrame, version: int, merge: Merge) -> int:
        """Write version `version`: of each touched bucket merge(old rows, changed rows). Gives the number of touched buckets."""
        before = [v for v in self.versions() if v < version]
        held = self.manifest(before[-1] if before else None)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        folder, change = f"data/v={version}", change.persist()  # a stream's batch is read twice
        try:
            # bounded by the number of buckets
            touched = sorted(r["b"] for r in change.select(bucket.alias("b")).distinct().collect())
            old = [f"{self.path}/{held[str(b)]}" for b in touched if str(b) in held]
            own = self.spark.read.parquet(*old) if old else self.spark.createDataFrame([], change.schema)
            merged = merge(own, change).withColumn("__bucket", bucket)
            merged.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        finally:
            change.unpersist()
        place = self._Path(f"{self.path}/{folder}")
        there = {x.getPath().getName().partition("=")[2] for x in self._files.listStatus(place) if x.isDirectory()}
        now = {b: f for b, f in held.items() if int(b) not in touched} | {b: f"{folder}/__bucket={b}" for b in there}
        self._put(version, now)
        self._drop({*now.values(), *held.values()}, [v for v in self.versions() if v < version and v != (before[-1] if before else None)], version)
        return len(touched)

    def _put(self, version: int, manifest: dict[str, str]) -> None:
        name, made = (self._Path(f"{self.path}/manifest/{version}{end}") for end in (".json", ".part"))
        out = self._files.create(made, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._files.exists(name):
            self._files.delete(name, False)
        self._files.rename(made, name)

    def _drop(self, used: set[str], versions: list[int], newest: int) -> None:
        for v in versions:
            self._files.delete(self._Path(f"{self.path}/manifest/{v}.json"), False)
        data = self._Path(f"{self.path}/data")
        for version in self._files.listStatus(data):
            if version.getPath().getName() == f"v={newest}":
                continue
            kept = 0
            for bucket in self._files.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if f"data/{version.getPath().getName()}/{name}" in used:
                    kept += 1
                elif name.startswith("__bucket="):
                    self._files.delete(bucket.getPath(), True)
            if not kept:
                self._files.delete(version.getPath(), True)


def replace_rows(keys: list[str]) -> Merge:
    """Changed rows take the place of the rows of their keys."""
    return lambda old, change: old.join(change.select(*keys).distinct(), keys, "left_anti").unionByName(change)
