"""A folder tree as a table of files: the driver lists the uppermost folders, the tasks walk and read what is below."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.lexicon import LANGUAGES, SKIP_DIRS

SCHEMA = "path string, relative_path string, language string, size_bytes bigint, repo_id string, content string, content_hash string"


class _Part(InputPartition):
    """A folder with all below it, or only the files right inside it."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def _inside(folder: str) -> tuple[list[str], list[str]]:
    """Folders to enter and files of a folder, in order; nothing where it cannot be read. Links to folders are not entered."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return [], []
    folders = [e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name not in SKIP_DIRS]
    return folders, [e.path for e in entries if not e.is_dir()]


class _Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int, max_kb: int):
        self.root, self.tasks, self.max_kb = root, tasks, max_kb

    def partitions(self) -> list[_Part]:
        """Folders of a level are opened until there are enough for the tasks, so the driver sees folders, not files."""
        parts, level = [], [self.root]
        while level and len(level) < self.tasks:
            below: list[str] = []
            for folder in level:
                parts.append(_Part(folder, False))
                below += _inside(folder)[0]
            level = below
        return parts + [_Part(folder, True) for folder in level]

    def read(self, partition: _Part) -> Iterator[tuple]:
        repo = hashlib.sha1(os.path.abspath(self.root).lower().encode()).hexdigest()[:12]
        todo = [partition.folder]
        while todo:
            folders, files = _inside(todo.pop(0))
            if partition.deep:
                todo += folders
            for path in files:
                relative = os.path.relpath(path, self.root).replace(os.sep, "/")
                language = LANGUAGES.get(os.path.splitext(relative)[1].lower())
                try:
                    size = os.path.getsize(path)
                    if self.max_kb and size > self.max_kb * 1024:
                        yield path, relative, language, size, repo, None, None
                        continue
                    with open(path, "rb") as file:
                        data = file.read()
                except OSError:
                    continue
                yield path, relative, language, len(data), repo, data.decode("utf-8", "replace"), hashlib.sha1(data).hexdigest()


class TreeSource(DataSource):
    """spark.read.format("lodestrata_tree").load(root): unlike binaryFile it also sees names with a leading underscore.

    Options: tasks (folders that are walked apart), max_kb (content and hash of larger files stay null, unread; 0 for none).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestrata_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("tasks", "256")), int(self.options.get("max_kb", "0")))


def read_tree(spark: SparkSession, root: str, tasks: int = 256, max_kb: int = 0) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("lodestrata_tree").option("tasks", str(tasks)).option("max_kb", str(max_kb)).load(root)


def ignore_rules(root: str) -> list[str]:
    """Rules of the root's ignore file; blank lines and comments are dropped."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as file:
            return [x.strip() for x in file if x.strip() and not x.strip().startswith("#")]
    except OSError:
        return []


def read_raw(files: DataFrame, path: str, limit: int = 8000) -> str | None:
    """The first characters of one file's content, None where there is no such file."""
    row = files.where(files["relative_path"] == path).selectExpr(f"substring(content, 1, {int(limit)}) AS content").first()
    return row["content"] if row else None


def repo_roots(files: DataFrame) -> DataFrame:
    """repo_id, root: what is left of the files' paths before their relative paths; null where files disagree."""
    root = "CASE WHEN endswith(path, concat('/', relative_path)) THEN substring(path, 1, length(path) - length(relative_path) - 1) END"
    found = files.selectExpr("repo_id", f"{root} AS root").groupBy("repo_id")
    from pyspark.sql import functions as F

    return found.agg(F.min("root").alias("low"), F.max("root").alias("high")).select("repo_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("root"))
