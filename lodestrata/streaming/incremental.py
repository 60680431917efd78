"""Incremental indexing as a stream: new file rows are chunked and upserted batch by batch, deleted files leave.

The index lies in buckets by a hash of the file. A batch writes only the buckets it touches, into a version of its own,
and then a manifest that names the version of each bucket; a reader sees the newest complete manifest. What no manifest
names any more is deleted with the batch after.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import CHUNK, chunk_files
from ..operators.scan import latest

KEYS = ["repo_id", "relative_path"]
#: Buckets of an index; one batch rewrites those it touches.
BUCKETS = 64


class IndexFolder:
    """The manifests and buckets of one index folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        where = self.path(self.folder)
        found = self.fs.listStatus(where) if self.fs.exists(where) else []
        return [n for n in (s.getPath().getName() for s in found) if n.startswith(prefix)]

    def manifest(self, before: int | None = None) -> dict[str, str]:
        """bucket to folder of the newest manifest, of the newest before a batch if one is given."""
        ids = [int(n[9:-5]) for n in self._names("manifest-") if n.endswith(".json")]
        ids = [i for i in ids if before is None or i < before]
        if not ids:
            return {}
        lines = self.spark.sparkContext.wholeTextFiles(f"{self.folder}/manifest-{max(ids)}.json").first()[1]
        return json.loads(lines)

    def write_manifest(self, batch: int, buckets: dict[str, str]) -> None:
        """Under another name first: a manifest is there as a whole or not at all."""
        fresh, name = self.path(f"{self.folder}/.manifest-{batch}"), self.path(f"{self.folder}/manifest-{batch}.json")
        out = self.fs.create(fresh, True)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        self.fs.delete(name, False)
        if not self.fs.rename(fresh, name):
            raise RuntimeError(f"cannot write {name}")

    def clean(self, batch: int) -> None:
        """Drop the manifests before the last two, and versions that neither of these names."""
        ids = sorted(int(n[9:-5]) for n in self._names("manifest-") if n.endswith(".json"))
        kept = set()
        for i in ids[-2:]:
            kept |= {v.split("/")[0] for v in json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/manifest-{i}.json").first()[1]).values()}
        for i in ids[:-2]:
            self.fs.delete(self.path(f"{self.folder}/manifest-{i}.json"), False)
        for name in self._names("batch="):
            if name not in kept and int(name[6:]) < batch:
                self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def read(self, buckets: dict[str, str]) -> DataFrame:
        paths = sorted(f"{self.folder}/{v}" for v in set(buckets.values()))
        if not paths:
            return self.spark.createDataFrame([], CHUNK)
        return self.spark.read.schema(CHUNK).parquet(*paths)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table as of the last complete batch."""
    index = IndexFolder(spark, folder)
    return index.read(index.manifest())


def _bucket(path: str) -> F.Column:
    return F.pmod(F.xxhash64("repo_id", path), F.lit(BUCKETS)).cast("int")


def apply_batch(files: DataFrame, batch_id: int, folder: str) -> None:
    """Chunks of a batch's newest file rows take the place of those their files had; a file whose newest row is marked as
    deleted leaves. A repeated batch writes the same."""
    spark = files.sparkSession
    index = IndexFolder(spark, folder)
    newest = latest(files.where(F.col("relative_path").isNotNull()), KEYS, ["loaded_at"])
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in files.columns else F.lit(False)
    touched = newest.select("repo_id", F.col("relative_path").alias("file_path"), _bucket("relative_path").alias("bucket"))
    numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS rows
    before = index.manifest(batch_id)
    old = index.read({k: v for k, v in before.items() if int(k) in numbers})
    kept = old.join(touched.select("repo_id", "file_path"), (old.repo_id.eqNullSafe(touched.repo_id)) & (old.file_path == touched.file_path), "left_anti")
    chunks = kept.unionByName(chunk_files(newest.where(~gone))).withColumn("bucket", _bucket("file_path"))
    target = f"{index.folder}/batch={batch_id}"
    chunks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = {n.getPath().getName()[7:] for n in index.fs.listStatus(index.path(target)) if n.getPath().getName().startswith("bucket=")}
    now = {k: v for k, v in before.items() if int(k) not in numbers} | {k: f"batch={batch_id}/bucket={k}" for k in written}
    index.write_manifest(batch_id, now)
    index.clean(batch_id)


def index_stream(spark: SparkSession, source: str, index: str, checkpoint: str) -> StreamingQuery:
    """Take in all file rows that have come to the source folder since the checkpoint, then stop."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, index))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_progress(query: StreamingQuery) -> list[dict]:
    """What each batch of a query took in: number, rows, rows a second."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rate": p.get("processedRowsPerSecond")} for p in query.recentProgress]
