"""A stored table whose changes rewrite only the parts they touch.

Rows lie in buckets by a hash of their key, each bucket in a folder of the
version that wrote it last. A small table per version, the manifest, names the
folders that make up the whole. A change reads the buckets of its keys, lets any
merge of the library work on them, writes them as a new version and then the
manifest: readers see the version before or after, never a mixture, and files of
other buckets are not touched.

One writer at a time. The version before the last stays readable, older folders
go with the next change, so neither reading nor storage grows with the number of
changes. Keys identify rows, so buckets are even; null is a key like any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.session import Scratch

BUCKET = "_bucket"
# The row without a bucket describes the table, the others name the version of a bucket.
MANIFEST = "bucket int, version bigint, batch bigint, buckets int, keys array<string>, layout string"
KEPT = 2

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Manifest(NamedTuple):
    version: int
    batch: int | None
    buckets: int
    keys: tuple[str, ...]
    schema: T.StructType
    parts: dict[int, int]


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> BucketedTable:
        """Store ``df`` as the first version; a table already there is an error."""
        table = cls(df.sparkSession, path)
        if BUCKET in df.columns:
            raise ValueError(f"a column is called {BUCKET}")
        if table._versions():
            raise ValueError(f"{path} holds a table")
        first = Manifest(0, None, buckets, tuple(keys), df.schema, {})
        table._commit(first._replace(parts=dict.fromkeys(table._save(df, first, 0), 0)))
        return table

    def read(self) -> DataFrame:
        return self._rows(self.spark, self._manifest())

    def version(self) -> int:
        return max(self._versions())

    def apply(self, changes: DataFrame, merge: Merge, batch: int | None = None) -> int:
        """Put ``merge(rows, changes)`` in place of the rows in the buckets of the changes' keys; returns the version.

        The merge must leave a row in its bucket: one whose key no change names
        may not come out of it unless it went in. With ``batch``, a number that
        grows, a batch already applied is left out, so it can be delivered again.
        """
        now = self._manifest()
        if batch is not None and now.batch is not None and batch <= now.batch:
            return now.version
        spark = changes.sparkSession
        scratch = Scratch(spark, "changes")
        changes = scratch.written(changes, "changes")
        # At most one number for each bucket.
        touched = {r[0] for r in changes.select(self._bucket(now).alias(BUCKET)).distinct().collect()}
        version = now.version + 1
        merged = merge(self._rows(spark, now, touched), changes)
        saved = self._save(merged, now, version)
        if not saved <= touched:
            raise ValueError(f"the merge made rows in buckets without a change: {sorted(saved - touched)}")
        parts = {b: v for b, v in now.parts.items() if b not in touched} | dict.fromkeys(saved, version)
        self._commit(now._replace(version=version, batch=now.batch if batch is None else batch, parts=parts))
        scratch.drop()
        self._expire()
        return version

    # --- parts ------------------------------------------------------------

    def _bucket(self, table: Manifest):
        # The stored types: equal keys of another width would hash apart.
        keys = [F.col(k).cast(table.schema[k].dataType) for k in table.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(table.buckets)).cast("int")

    def _rows(self, spark: SparkSession, table: Manifest, wanted: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{v}/{BUCKET}={b}" for b, v in sorted(table.parts.items()) if wanted is None or b in wanted]
        return spark.read.schema(table.schema).parquet(*paths) if paths else spark.createDataFrame([], table.schema)

    def _save(self, rows: DataFrame, table: Manifest, version: int) -> set[int]:
        """Write rows by bucket and return the buckets that have any."""
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        placed = typed.withColumn(BUCKET, self._bucket(table))
        # A task holds whole buckets, cut only where one is large.
        folder = f"{self.path}/data/{version}"
        placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        return {int(name.partition("=")[2]) for name in self._names(folder) if name.startswith(f"{BUCKET}=")}

    # --- manifests --------------------------------------------------------

    def _manifest(self, version: int | None = None) -> Manifest:
        found = self._versions()
        if not found:
            raise ValueError(f"{self.path} holds no table")
        version = max(found) if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version}").collect()
        about = next(r for r in rows if r.bucket is None)
        parts = {r.bucket: r.version for r in rows if r.bucket is not None}
        return Manifest(version, about.batch, about.buckets, tuple(about["keys"]), T.StructType.fromJson(json.loads(about.layout)), parts)

    def _commit(self, table: Manifest) -> None:
        about = (None, table.version, table.batch, table.buckets, list(table.keys), table.schema.json())
        rows = [about, *[(b, v, None, None, None, None) for b, v in table.parts.items()]]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{table.version}")

    def _versions(self) -> list[int]:
        """Versions whose manifest was written to its end."""
        folder = f"{self.path}/manifest"
        return sorted(int(name) for name in self._names(folder) if "_SUCCESS" in self._names(f"{folder}/{name}"))

    def _expire(self) -> None:
        """Remove what only versions before the kept ones read; the oldest manifest goes after its folders."""
        versions = self._versions()
        kept = [self._manifest(v).parts for v in versions[-KEPT:]]
        used = {part for parts in kept for part in parts.items()}
        folders = {v for _, v in used}
        for version in versions[:-KEPT]:
            for bucket, written_by in self._manifest(version).parts.items():
                if written_by not in folders:
                    self._remove(f"data/{written_by}")
                elif (bucket, written_by) not in used:
                    self._remove(f"data/{written_by}/{BUCKET}={bucket}")
            self._remove(f"manifest/{version}")

    # --- files ------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        system = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def _remove(self, relative: str) -> None:
        path = self._hadoop.Path(f"{self.path}/{relative}")
        path.getFileSystem(self._conf).delete(path, True)
