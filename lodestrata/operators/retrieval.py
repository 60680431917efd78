"""Rank fusion, literal search, span merging and reranking of retrieved chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lines, simple_tokens
from .lexical import rrf
from .lexical import top_k as best_of

VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3
PER_FILE, WINDOW_BEFORE, WINDOW_AFTER, GREP_SCORE = 15, 10, 10, 1.2
BUCKET = 15


def fuse(lists: list[tuple[DataFrame, float]], key: str = "doc_id", by: str = "query_id") -> DataFrame:
    """Weighted reciprocal rank sum of ranked lists (by, key, rank)."""
    parts = [df.select(by, key, (rrf(F.col("rank")) * w).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(by, key).agg(F.sum("part").alias("score"))


def strategy_weight(position: int) -> float:
    """Weights of query variants; the last goes on."""
    weights = (1.0, 0.85, 0.75, 0.65, 0.6)
    return weights[min(position, len(weights) - 1)]


def multi_strategy(answer: DataFrame | None, variants: list[DataFrame], lexical: DataFrame, literal: DataFrame | None, top_k: int) -> DataFrame:
    """Fusion of the answer-like list (1.5), the variants, the lexical (0.8) and the literal (1.2) list, with the low fifth cut."""
    lists = ([(answer, 1.5)] if answer is not None else []) + [(v, strategy_weight(i)) for i, v in enumerate(variants)]
    lists += [(lexical, 0.8)] + ([(literal, 1.2)] if literal is not None else [])
    return cut_low(fuse(lists).withColumn("score", F.round("score", 4)), top_k)


def cut_low(scored: DataFrame, top_k: int, by: str = "query_id") -> DataFrame:
    """Rows from the 20th percentile up, where more than twice top_k are there and top_k remain."""
    up = Window.partitionBy(by).orderBy("score")
    whole = Window.partitionBy(by)
    ranked = scored.withColumn("place", F.row_number().over(up) - 1).withColumn("n", F.count("*").over(whole))
    index = F.greatest(F.lit(0), F.col("n") - F.floor(F.col("n") * 0.8) - 1)
    edged = ranked.withColumn("edge", F.max(F.when(F.col("place") == index, F.col("score"))).over(whole))
    edged = edged.withColumn("remain", F.sum((F.col("score") >= F.col("edge")).cast("int")).over(whole))
    applies = (F.col("n") > 2 * top_k) & (F.col("remain") >= top_k)
    return edged.where(~applies | (F.col("score") >= F.col("edge"))).drop("place", "n", "edge", "remain")


def hybrid(vector: DataFrame, lexical: DataFrame, top_k: int, corpus: DataFrame | None = None, file_scoped: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of the fused lists; only lexical ones, unweighted, when a file is named."""
    found = fuse([(lexical, 1.0)]) if file_scoped else fuse([(vector, VECTOR_WEIGHT), (lexical, LEXICAL_WEIGHT)])
    if corpus is not None:
        found = found.join(corpus.select("doc_id"), "doc_id", "left_semi")
    return best_of(found, top_k, best=F.round("score", 12))


def file_lines(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """path, line_number (from 1), line of every line of every file."""
    return files.select(path, F.posexplode(lines(F.col(text))).alias("at", "line")).select(path, (F.col("at") + 1).alias("line_number"), "line")


def grep(rows: DataFrame, terms: list[str], path: str = "file_path", regex: bool = False, per_file: int = PER_FILE) -> DataFrame:
    """path, line_number, line, term, term_ord: lines that hold a term, whatever its case.

    The first per_file lines of each term and file count; a line goes to the first term that matches it. The terms are
    tested by one pass over the lines, without a join.
    """
    asked = [t.strip() for t in terms if t.strip()]
    low = F.lower(F.col("line"))
    hits = [
        F.when(F.col("line").rlike("(?i)" + t) if regex else low.contains(t.lower()), F.struct(F.lit(i).alias("term_ord"), F.lit(t).alias("term")))
        for i, t in enumerate(asked)
    ]
    if not hits:
        return rows.where("false").select(path, "line_number", "line", F.lit("").alias("term"), F.lit(0).alias("term_ord"))
    found = rows.select(path, "line_number", "line", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(
        path, "line_number", "line", "hit.term", "hit.term_ord"
    )
    w = Window.partitionBy("term_ord", path).orderBy("line_number")
    capped = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_file).drop("nth")
    first = F.min_by(F.struct("line", "term", "term_ord"), "term_ord").alias("hit")
    return capped.groupBy(path, "line_number").agg(first).select(path, "line_number", "hit.*")


def grep_windows(matches: DataFrame, files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """Chunks of lines around matches, one per window start; name lists its terms in order, without those already in it."""
    start = F.greatest(F.lit(0), F.col("line_number") - WINDOW_BEFORE - 1)
    by_window = matches.withColumn("from_line", start).groupBy(path, "from_line").agg(
        F.sort_array(F.collect_list(F.struct("term_ord", "line_number", "term"))).alias("hits")
    )
    # the first match, by term and line, sets where the window ends
    by_window = by_window.withColumn("term_ord", F.col("hits")[0]["term_ord"]).withColumn("line_number", F.col("hits")[0]["line_number"])
    name = F.aggregate(
        F.transform("hits", lambda h: h["term"]),
        F.lit(""),
        lambda s, t: F.when(s == "", t).when(s.contains(t), s).otherwise(F.concat(s, F.lit(","), t)),
    )
    joined = by_window.join(files.select(path, lines(F.col(text)).alias("rows")), path)
    stop = F.least(F.size("rows"), F.col("line_number") + WINDOW_AFTER - 1)
    return joined.select(
        F.concat(F.col(path), F.lit(":"), (F.col("from_line") + 1).cast("string"), F.lit("-"), stop.cast("string"), F.lit(":grep")).alias("id"),
        path, (F.col("from_line") + 1).alias("start_line"), stop.alias("end_line"), name.alias("name"), F.lit(GREP_SCORE).alias("score"),
        F.array_join(F.slice("rows", F.col("from_line") + 1, stop - F.col("from_line")), "\n").alias("content"), "term_ord", "line_number",
    )


def merge_spans(literal: DataFrame, semantic: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """Rows of (file_path, start_line, id, score, ord) of both lists, one per file and bucket of 15 lines.

    Of literal rows the highest score counts, the first on ties; every semantic row after it, or after the first semantic
    one, adds half its score, and the last semantic row gives the payload. Each hint in the path adds 0.3. ord (of any type
    that sorts, the same in both lists) comes out as a struct that sorts what a literal row began before the rest.
    """
    both = literal.withColumn("literal", F.lit(True)).unionByName(semantic.withColumn("literal", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("bucket", (F.floor(F.col("start_line") / BUCKET) * BUCKET).cast("int"))
    row = F.struct("id", "start_line")
    g, s = F.col("literal"), ~F.col("literal")
    merged = both.groupBy("file_path", "bucket").agg(
        F.max(F.when(g, F.col("score"))).alias("best"),
        F.min_by(F.when(g, row), F.when(g, F.struct(-F.col("score"), F.col("ord")))).alias("from_literal"),
        F.min(F.struct((~g).alias("late"), F.col("ord").alias("at"))).alias("ord"),
        F.sum(F.when(s, F.col("score"))).alias("total"),
        F.min_by(F.when(s, F.col("score")), F.when(s, F.col("ord"))).alias("first"),
        F.max_by(F.when(s, row), F.when(s, F.col("ord"))).alias("from_semantic"),
    )
    total = F.coalesce("total", F.lit(0.0))
    base = F.when(F.col("best").isNotNull(), F.col("best") + 0.5 * total).otherwise(F.col("first") + 0.5 * (total - F.col("first")))
    bonus = sum((F.when(F.contains(F.lower("file_path"), F.lit(h.lower())), 0.3).otherwise(0.0) for h in hints or []), F.lit(0.0))
    kept = F.coalesce("from_semantic", "from_literal")
    return merged.select("file_path", "bucket", kept["id"].alias("id"), kept["start_line"].alias("start_line"), (base + bonus).alias("score"), "ord")


def rerank(chunks: DataFrame, query: str, terms: list[str], top_k: int, task: str = "general", least_overlap: float = 0.05) -> DataFrame:
    """chunks (file_path, name, content, score, and ord, which is unique) with the score raised by exact terms, names and
    shared tokens, lowered for strangers, tests and further chunks of a file; the top_k best with their rank."""
    spark: SparkSession = chunks.sparkSession
    words = sorted({t.lower() for t in terms if t})
    # tokens of one question: computed once, as literals
    asked = spark.range(1).select(simple_tokens(F.lit(query)).alias("q"), simple_tokens(F.lit(" ".join(terms))).alias("p")).first()
    q, p = (F.array(*[F.lit(x) for x in asked[k]]).cast("array<string>") for k in ("q", "p"))
    content, name = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    hits = sum((F.when(content.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    own = simple_tokens(F.coalesce(F.col("content"), F.lit("")))

    def shared(asked_tokens: Column, n: int) -> Column:
        return F.size(F.array_intersect(asked_tokens, F.col("own"))) / max(n, 1)

    scored = chunks.withColumn("own", own).withColumn("hits", hits)
    scored = scored.withColumn("oq", shared(q, len(asked["q"]))).withColumn("op", shared(p, len(asked["p"])))
    score = F.col("score") + 2.0 * F.col("hits") + F.when(name.isin(words) if words else F.lit(False), 3.0).otherwise(0.0)
    score = score + 0.5 * F.col("oq") + 0.8 * F.col("op")
    score = score * F.when((F.greatest("oq", "op") < least_overlap) & (F.col("hits") == 0), 0.3).otherwise(1.0)
    if task not in ("review", "debug"):
        path = F.lower("file_path")
        score = score * F.when(path.contains("test") | path.contains("spec"), 0.6).otherwise(1.0)
    # contents stay out of the window and the sort; they come back for the top_k rows
    slim = diversified(scored.select("file_path", "ord", score.alias("score"))).select("ord", F.round("score", 4).alias("score"))
    best = slim.orderBy(F.desc("score"), "ord").limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")) - 1)
    return chunks.drop("score", "rank").join(F.broadcast(best), "ord")


def diversified(chunks: DataFrame) -> DataFrame:
    """Each further chunk of a file, in input order, weighs 1 / (1 + 0.5 n)."""
    w = Window.partitionBy("file_path").orderBy("ord")
    return chunks.withColumn("score", F.col("score") / (1 + 0.5 * (F.row_number().over(w) - 1)))


def compile_filter(where: dict | None) -> Column:
    """Nested $and and $or of equalities as a predicate; $and ends the reading of its level, unknown operators are ignored."""
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(lambda a, b: a & b, [compile_filter(x) for x in where["$and"]], F.lit(True))
    if "$or" in where:
        return reduce(lambda a, b: a | b, [compile_filter(x) for x in where["$or"]], F.lit(False))
    parts = [F.col(k) == F.lit(v) for k, v in where.items() if not k.startswith("$")]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def path_filter(path: Column, part: str) -> Column:
    return F.translate(path, "\\", "/").contains(part.replace("\\", "/"))
