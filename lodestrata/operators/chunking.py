"""Files to chunks: overlapping line windows in the JVM, declarations by each language's grammar."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from .grammar import Node, declarations
from .scan import chunk_id

MAX_LINES, OVERLAP, MIN_LINES, EMBED_CHARS = 60, 10, 3, 2048

CHUNK = (
    "id string, repo_id string, file_path string, language string, start_line int, end_line int, chunk_type string, "
    "name string, context_header string, content string"
)


def line_windows(text: Column, size: int = MAX_LINES, overlap: int = OVERLAP, least: int = MIN_LINES) -> Column:
    """Array of (start_line, end_line, content): windows every size - overlap lines, the first of fewer than least ends it."""
    rows = lines(text)
    n = F.size(rows)
    starts = F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.struct(
            (s + 1).alias("start_line"),
            F.least(s + size, n).alias("end_line"),
            F.array_join(F.slice(rows, s + 1, size), "\n").alias("content"),
        ),
    )


def window_chunks(files: DataFrame) -> DataFrame:
    """Line windows of every file of (repo_id, relative_path, language, content); empty and null contents give none."""
    part = files.where(F.length("content") > 0).select(
        "repo_id", F.col("relative_path").alias("file_path"), "language", F.explode(line_windows(F.col("content"))).alias("w")
    )
    return part.select(
        chunk_id(F.col("repo_id"), F.col("file_path"), F.col("w.start_line"), F.col("w.end_line")).alias("id"),
        "repo_id", "file_path", "language", "w.start_line", "w.end_line", F.lit("block").alias("chunk_type"),
        F.lit(None).cast("string").alias("name"), F.col("file_path").alias("context_header"), "w.content",
    )


def python_declarations(text: str) -> list[Node]:
    """Declarations of a Python text by the standard parser; empty where it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def nodes(body: list[ast.stmt]) -> list[Node]:
        return [Node(type(n).__name__, n.name, n.lineno, n.end_lineno, nodes(n.body)) for n in body if isinstance(n, kinds)]

    return nodes(tree.body)


def _windows(start: int, end: int, context: str) -> list[tuple]:
    """Windows of lines from start to end; the first of fewer than the least number ends them."""
    out = []
    while end - start + 1 >= MIN_LINES:
        out.append((start, min(start + MAX_LINES - 1, end), "block", None, context))
        start += MAX_LINES - OVERLAP
    return out


def _parts(nodes: list[Node], parent: str = "") -> list[tuple]:
    """(start, end, type, name, context): whole declarations, oversized ones by their members, else by windows."""
    out: list[tuple] = []
    for node in nodes:
        size = node.end - node.start + 1
        if size < MIN_LINES:
            continue
        context = f"{parent} > {node.name}" if parent and node.name else (node.name or node.kind)
        if size <= MAX_LINES:
            out.append((node.start, node.end, node.kind, node.name, context))
        else:
            out.extend(_parts(node.members, context) if node.members else _windows(node.start, node.end, context))
    return out


def declared_parts(language: str | None, text: str) -> list[tuple]:
    if language == "python":
        return _parts(python_declarations(text))
    return _parts(declarations(language, text)) if language else []


def _chunked(files: DataFrame, fallback: bool) -> DataFrame:
    """One pass over files: declarations, and line windows for those without any if fallback."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for repo, path, language, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows = text.splitlines()
                parts = declared_parts(language, text)
                if not parts and fallback:
                    parts = _windows(1, len(rows), path)
                for start, end, kind, name, context in parts:
                    out.append(
                        {
                            "id": f"{repo}:{path}:{start}-{end}" if repo else f"{path}:{start}-{end}", "repo_id": repo, "file_path": path,
                            "language": language, "start_line": start, "end_line": end, "chunk_type": kind, "name": name,
                            "context_header": context, "content": "\n".join(rows[start - 1 : end]),
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    rows = files.where((F.length("content") > 0) & F.col("relative_path").isNotNull())
    return rows.select("repo_id", F.col("relative_path").alias("file_path"), "language", "content").mapInArrow(parse, CHUNK)


def python_chunks(files: DataFrame) -> DataFrame:
    """Declarations of Python files, oversized ones by their members or line windows. Files without any give none."""
    return _chunked(files.where(F.col("language") == "python"), False)


_ARROW = pa.schema(
    [(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in CHUNK.split(", "))]
)


def chunk_files(files: DataFrame) -> DataFrame:
    """Declarations where the language's grammar finds any, line windows for all other files; each file is parsed once.

    Null and empty contents and null paths give none; lines are those of Python's splitlines.
    """
    return _chunked(files, True)


def embedding_text(chunks: DataFrame, limit: int = EMBED_CHARS) -> Column:
    """Context, the last three path parts and the content, together at most limit characters."""
    path = F.array_join(F.slice(F.split("file_path", "/"), F.greatest(F.size(F.split("file_path", "/")) - 2, F.lit(1)), 3), "/")
    head = F.concat(F.lit("# "), F.coalesce("context_header", F.lit("")), F.lit("\n# "), path, F.lit("\n"))
    return F.concat(head, F.substr(F.col("content"), F.lit(1), F.greatest(limit - F.length(head), F.lit(0))))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks and nearest-rank percentiles (the value at index int(n * p)) of content length per language.

    The lengths are counted first, so a language's rows never come together; the ranks run over distinct lengths.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    counted = chunks.groupBy("language", size.alias("size")).agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("language").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("k").over(w))
    totals = counted.groupBy("language").agg(F.sum("k").alias("chunks"), F.min("size").alias("least"), F.max("size").alias("most"))
    ranked = upto.join(totals.withColumnRenamed("language", "lang"), F.col("language").eqNullSafe(F.col("lang")))

    def at(p: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("chunks") * p), F.col("size")))

    return ranked.groupBy("language").agg(
        F.max("chunks").alias("chunks"), F.max("least").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("most").alias("most")
    )
