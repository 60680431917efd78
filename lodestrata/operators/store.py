"""The chunk table: last write wins, deletions, resume, and rates over its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import latest


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of new in the place of those of the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_write(chunks: DataFrame) -> DataFrame:
    return latest(chunks, ["id"], ["indexed_at", "ord"])


def delete_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those of the given (repo_id, relative_path), in one pass."""
    paths = gone.select("repo_id", F.col("relative_path").alias("file_path")).distinct()
    return chunks.join(paths, ["repo_id", "file_path"], "left_anti")


def delete_repo(chunks: DataFrame, repo: str) -> DataFrame:
    return chunks.where(~F.col("repo_id").eqNullSafe(F.lit(repo)))


def not_stored(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    return chunks.join(stored.select("id"), "id", "left_anti")


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id"), "id", "left_semi")


def with_vector(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Chunks whose embedding came out; null and empty vectors are left out."""
    return chunks.where(F.coalesce(F.size(vector), F.lit(0)) > 0)


def snapshot(files: DataFrame) -> DataFrame:
    """repo_id, relative_path, content_hash of a scan, one row per file: what the next scan is compared with."""
    hashed = F.coalesce("content_hash", F.sha1("content"))
    return files.where(hashed.isNotNull()).groupBy("repo_id", "relative_path").agg(F.max(hashed).alias("content_hash"))


def write_snapshot(files: DataFrame, path: str) -> None:
    """Replace the hash state at path by that of a scan; the old one stays readable until the new one is complete."""
    spark = files.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    snapshot(files).write.mode("overwrite").parquet(path + ".new")
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    if not fs.rename(fresh, target):
        raise RuntimeError(f"cannot move the new hash state to {path}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The hash state at path; none before the first scan."""
    shape = "repo_id string, relative_path string, content_hash string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path)


def symbol_vocabulary(chunks: DataFrame, rows: int = 1500, names: int = 500) -> DataFrame:
    """name, first_ord: up to 500 names of the first 1,500 chunks, in order: the fuzzy matcher's bounded list."""
    first = chunks.orderBy("ord").limit(rows).where((F.length("name") >= 5) & ~F.col("name").rlike(r"^\d+$"))
    return first.groupBy("name").agg(F.min("ord").alias("first_ord")).orderBy("first_ord").limit(names)


#: Ranges of the order column that running numbers and sums are computed in, each in its own task.
RANGES = 64


def _ranged(df: DataFrame, order: Column, ranges: int = RANGES) -> DataFrame:
    """df with range: which of some equally filled ranges of the order column a row is in. Sketched from all rows."""
    edges = df.select(F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000)).first()[0] or []
    edges = sorted(set(edges))
    if not edges:
        return df.withColumn("range", F.lit(0))
    known = F.array(*[F.lit(e) for e in edges])
    return df.withColumn("range", F.size(F.filter(known, lambda e: e <= order)))


def _running(df: DataFrame, by: str, order: list[str], **sums: Column) -> DataFrame:
    """df with nth (from 1) and running sums up to each row, by two levels: within ranges, and over the ranges' totals.

    Needs df.range; a whole group never meets in one task.
    """
    inner = Window.partitionBy(by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    values = {"nth": F.lit(1)} | sums
    totals = df.groupBy(by, "range").agg(*[F.sum(v).alias(f"all_{k}") for k, v in values.items()])
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "range", *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"all_{k}") for k in values])
    found = df.select("*", *[F.sum(v).over(inner).alias(f"own_{k}") for k, v in values.items()]).join(totals, [by, "range"])
    return found.select(*df.columns, *[(F.col(f"own_{k}") + F.col(f"all_{k}")).alias(k) for k in values]).drop("range")


def rolling_rate(events: DataFrame, by: str, ts: str = "ts", key: str = "event_id", window: int = 200, every: int = 20) -> DataFrame:
    """Rows per second over the last 200 completions of each group, at every 20th.

    Rows are numbered in ranges of time; a row then meets the one 199 before it by its number.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = _ranged(events.select(by, micros.alias("at"), key), F.col("at"))
    numbered = _running(slim, by, ["at", key]).select(by, "nth", "at")
    asked = numbered.where(F.col("nth") % every == 0).withColumn("start", F.greatest(F.col("nth") - (window - 1), F.lit(1)))
    first = numbered.select(by, F.col("nth").alias("start"), F.col("at").alias("began"))
    seconds = (F.col("at") - F.col("began")) / 1e6
    return asked.join(first, [by, "start"]).select(by, "nth", F.try_divide(F.col("nth") - F.col("start"), seconds).alias("rate"))


def folder_eta(times: DataFrame, order: str, seconds: str) -> DataFrame:
    """Remaining folders times the mean time of those before, per run; null for the first."""
    found = _running(_ranged(times, F.col(order)), "run", [order], total=F.col(seconds))
    whole = times.groupBy("run").agg(F.count("*").alias("of_run"))
    left = F.col("of_run") - F.col("nth") + 1
    eta = left * F.try_divide(F.col("total") - F.col(seconds), F.col("nth") - 1)
    return found.join(whole, "run").select(*times.columns, eta.alias("eta"))


def with_defaults(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
        F.coalesce("chunk_type", F.lit("block")).alias("chunk_type"), F.coalesce("name", F.lit("")).alias("name"),
    )


def metadata_filter(language: str | None = None, repo: str | None = None) -> Column:
    """Equalities that push down to the scan."""
    found = F.lit(True)
    if language:
        found = found & (F.col("language") == language)
    if repo:
        found = found & (F.col("repo_id") == repo)
    return found
