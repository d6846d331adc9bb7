"""A keyed table in versions: a write makes new files for the buckets that it touches, and a manifest of all buckets.

A version counts once its manifest is complete, so a write that fails midway leaves the one before. A version that is
written again (a batch that runs twice) starts from the one before it and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _versions(self) -> list[int]:
        """Versions whose manifests are complete, from the folder itself: nothing is remembered in the driver."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self, before: int | None = None) -> int | None:
        """The last version, or the last one under ``before``."""
        return max((v for v in self._versions() if before is None or v < before), default=None)

    def _manifest(self, version: int | None) -> dict[int, int]:
        """bucket to the version that holds its files; there are as many lines as buckets at most."""
        if version is None:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifest/v{version}").collect()
        return {int(k): v for r in lines for k, v in json.loads(r["value"]).items()}

    def _files(self, manifest: dict[int, int]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if not manifest:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(manifest.items())])

    def read(self) -> DataFrame:
        return self._files(self._manifest(self.version()))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], version: int | None = None) -> None:
        """``change`` of the rows in the buckets of the keys ``touched``; other buckets stay where they are."""
        before = self.version(version)
        version = (before + 1 if before is not None else 0) if version is None else version
        manifest = self._manifest(before)
        some = sorted(r["b"] for r in touched.select(self.bucket().alias("b")).distinct().collect())  # as many as buckets at most
        rows = change(self._files({b: v for b, v in manifest.items() if b in some}))
        if some:
            out = f"{self.path}/data/v{version}"
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
            made = self._made(out)
            manifest = {b: v for b, v in manifest.items() if b not in some} | dict.fromkeys(sorted(made), version)
        lines = self.spark.createDataFrame([(json.dumps({str(b): v}),) for b, v in sorted(manifest.items())], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{version}")

    def _made(self, folder: str) -> set[int]:
        """The buckets that a write made, by their folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {int(s.getPath().getName()[7:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}

    def clear(self) -> None:
        """An empty version; files of older ones stay until :meth:`vacuum`."""
        version = self.version()
        self.spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{0 if version is None else version + 1}")

    def vacuum(self) -> None:
        """Deletes files and manifests that the last version doesn't name."""
        last = self.version()
        if last is None:
            return
        jvm, kept = self.spark._jvm, self._manifest(last)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in self._versions():
            if v != last:
                p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{v}")
                p.getFileSystem(conf).delete(p, True)
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = data.getFileSystem(conf)
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and kept.get(int(name[7:])) != int(folder.getPath().getName()[1:]):
                    fs.delete(part.getPath(), True)
