"""Versioned tables: keyed upserts whose versions are published whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """A table by key under ``path``, in buckets of the key's hash.

    A version is a manifest: the folder of each bucket, and the last batch of each writer. An upsert writes the touched buckets
    anew, beside the old ones, and publishes the next manifest by renaming a file; until then readers see the old version,
    and what a killed write leaves behind is in no manifest. A batch whose number is not above its writer's last one
    changes nothing, so that a batch may run again. Two writers that publish the same version at once: the second one fails.
    Rows with a null key are one row's. Buckets bound what an upsert rewrites and are fixed at creation.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"folders": {}, "writers": {}, "buckets": self.buckets}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:010}.json", wholetext=True).first()[0])

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest appears under its name whole, or not at all if the name is taken."""
        hidden, name = (self._at(f"{self.path}/_versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:010}.json"))
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(hidden, name):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"version {version} was published by another writer")

    def last_batch(self, writer: str = "default") -> int | None:
        return self._manifest(max(self.versions(), default=0))["writers"].get(writer)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest one if none is named; none before the first)."""
        version = max(self.versions(), default=0) if version is None else version
        return self._rows(list(self._manifest(version)["folders"].values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def upsert(self, rows: DataFrame, batch: int, writer: str = "default", order: list[Column] | None = None) -> bool:
        """Insert rows or replace those of their keys; of new rows that share a key the first by ``order`` (if none is
        given, any). False if the writer's batch was published before. Only bucket numbers reach the driver."""
        from embergrid.operators.events import keep_last
        from embergrid.sources.tables import cut

        version = max(self.versions(), default=0)
        old = self._manifest(version)
        if old["buckets"] != self.buckets:
            raise ValueError(f"the table has {old['buckets']} buckets")
        if (last := old["writers"].get(writer)) is not None and batch <= last:
            return False
        new = keep_last(rows, [self.key], order) if order else rows.dropDuplicates([self.key])
        names = [f.name for f in self.schema]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        new = cut(new.select(*names, bucket))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        folders = dict(old["folders"])
        if touched:
            kept = self._rows([folders[str(b)] for b in touched if str(b) in folders]).alias("o").join(new.select(F.col(self.key).alias("__key")), F.col(f"o.{self.key}").eqNullSafe(F.col("__key")), "left_anti")
            folder = f"data/v={version + 1}-{uuid.uuid4().hex}"
            both = kept.select(*names, bucket).unionByName(new)
            both.repartitionByRange("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders |= {str(b): f"{folder}/bucket={b}" for b in touched}
        self._publish(version + 1, {"folders": folders, "writers": old["writers"] | {writer: batch}, "buckets": self.buckets})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the last ``keep`` versions and delete folders that none of those names; how many went."""
        versions = self.versions()
        held = {f.rsplit("/", 1)[0] for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self.path}/_versions/{v:010}.json"), False)
        data = self._at(f"{self.path}/data")
        there = [f.getPath() for f in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = [p for p in there if f"data/{p.getName()}" not in held]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
