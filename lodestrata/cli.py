"""python -m lodestrata.cli analyze PATH | index PATH STORE | ask STORE QUESTION | stats STORE

A store is a folder with chunks, files, vectors, and the hash state of the last scan. index takes in what changed.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, lexical, pipeline, scan, store, vectors
from .session import local_session, ship
from .sources.tree import ignore_rules, read_tree


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/{name}") if there else None


def _replace(df: DataFrame, path: str) -> None:
    """Write df, which may read the table at path, in the place of that table."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def selected(spark: SparkSession, root: str, profile: str | None = None) -> DataFrame:
    """The files of a tree that a scan keeps, with their language by ending."""
    kept = scan.select_files(read_tree(spark, root), profile=profile, ignore=ignore_rules(root))
    return kept.withColumn("language", F.col("file_language")).drop("file_language")


def analyze(spark: SparkSession, root: str) -> str:
    files = read_tree(spark, root)
    row = scan.format_analysis(scan.plan_areas(files), files).first()
    return row["text"] if row else f"Repo: {root}\nno files"


def index(spark: SparkSession, root: str, folder: str, profile: str | None = None, force: bool = False) -> dict[str, int]:
    """Files added or changed since the last scan are chunked and embedded anew, deleted ones leave; the counts of it."""
    files = selected(spark, root, profile)
    state = store.read_snapshot(spark, f"{folder}/state")
    state = state.where("false") if force else state
    changed, gone = scan.changed_files(files, state), scan.deleted_files(files, state)
    left = changed.select("repo_id", "relative_path").unionByName(gone)
    before = None if force else _read(spark, folder, "chunks")
    fresh = chunking.chunk_files(changed)
    fresh = fresh.withColumn("embedding", vectors.embed(chunking.embedding_text(fresh))).withColumn("ord", F.xxhash64("id"))
    chunks = fresh if before is None else store.delete_files(before, left).unionByName(fresh)
    counts = {"changed": changed.count(), "deleted": gone.count()}
    _replace(chunks, f"{folder}/chunks")
    _replace(files.select("repo_id", F.col("relative_path").alias("file_path"), "content"), f"{folder}/files")
    store.write_snapshot(files, f"{folder}/state")
    return counts | {"chunks": spark.read.parquet(f"{folder}/chunks").count()}


def corpus(spark: SparkSession, folder: str, language: str | None = None, repo: str | None = None) -> pipeline.Corpus:
    chunks = spark.read.parquet(f"{folder}/chunks").where(store.metadata_filter(language, repo))
    return pipeline.Corpus(
        spark.read.parquet(f"{folder}/files"), chunks.drop("embedding"), lexical.build_index(chunks, "ord", "content"),
        store.with_vector(chunks).select("ord", "embedding"), lambda q: vectors.hashed_embeddings([q])[0].tolist(),
    )


def ask(spark: SparkSession, folder: str, question: str, top_k: int = 5, task: str = "general", **where: str | None) -> dict:
    """system, user, context, sources, max_tokens of the prompt for a question."""
    plan, found = pipeline.run_pipeline(corpus(spark, folder, **where), question, top_k, task=task)
    return pipeline.prompt_of(found, plan).first().asDict()


def stats(spark: SparkSession, folder: str) -> list[dict]:
    return [r.asDict() for r in chunking.chunk_statistics(spark.read.parquet(f"{folder}/chunks")).orderBy("language").collect()]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestrata", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("analyze").add_argument("path")
    one = commands.add_parser("index")
    one.add_argument("path")
    one.add_argument("store")
    one.add_argument("--profile")
    one.add_argument("--force", action="store_true")
    one = commands.add_parser("ask")
    one.add_argument("store")
    one.add_argument("question")
    one.add_argument("--top-k", type=int, default=5)
    one.add_argument("--task", default="general", choices=pipeline.TASKS)
    one.add_argument("--language")
    one.add_argument("--repo")
    commands.add_parser("stats").add_argument("store")
    asked = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if asked.command == "analyze":
        print(analyze(spark, os.path.abspath(asked.path)))
    elif asked.command == "index":
        print(index(spark, os.path.abspath(asked.path), asked.store, asked.profile, asked.force))
    elif asked.command == "ask":
        found = ask(spark, asked.store, asked.question, asked.top_k, asked.task, language=asked.language, repo=asked.repo)
        print(found["system"], found["user"], sep="\n\n")
    else:
        for row in stats(spark, asked.store):
            print(row)


if __name__ == "__main__":
    main()
