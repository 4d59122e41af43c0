"""A keyed table in buckets, of which a batch rewrites only those that it touches.

A row lies in the bucket of its key's hash. A batch writes new folders for the
buckets that it touches, and then a manifest (bucket and folder, stream and its
last batch) under the next version; the newest manifest that is whole says what
the table is. So a reader sees the table before or after a batch, and a batch
that comes again finds its number and changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stream string, batch long, bucket int, folder string"


class Store:
    """A table of rows with `keys`, in `buckets` buckets below `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _found(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(s.getPath().getParent().getName() for s in status or [])

    def _manifest(self) -> tuple[int, dict[int, str], dict[str, int]]:
        """The version (-1: none), the folder of each bucket, and the last batch of each stream: a row a bucket and a stream."""
        whole = self._found("manifest-*/_SUCCESS")
        if not whole:
            return -1, {}, {}
        rows = self.spark.read.json(f"{self.path}/{whole[-1]}", schema=MANIFEST).collect()
        return int(whole[-1].split("-")[1]), {r["bucket"]: r["folder"] for r in rows if r["folder"]}, {r["stream"]: r["batch"] for r in rows if r["stream"]}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as the last whole batch left it."""
        return self._rows(list(self._manifest()[1].values()))

    def apply(self, batch: DataFrame, stream: str, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Puts merge(old rows, batch) in place of the touched buckets; False if this batch of the stream, or a later one, is in already."""
        version, folders, streams = self._manifest()
        if number <= streams.get(stream, -1):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # numbers of buckets
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        if touched:
            old = self._rows([folders[b] for b in touched if b in folders])
            rows = merge(old, batch).select(*old.columns, bucket.alias("_bucket"))
            rows.repartition(min(self.buckets, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
        made = {int(name.split("=")[1]) for name in self._found(f"{folder.rsplit('/', 1)[1]}/_bucket=*/*.parquet")} if touched else set()
        folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in made}
        lines = [(s, n, None, None) for s, n in (streams | {stream: number}).items()] + [(None, None, b, f) for b, f in folders.items()]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.json(f"{self.path}/manifest-{version + 1:09d}")
        return True
