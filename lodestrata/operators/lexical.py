"""Okapi BM25 over an inverted index table."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..session import drop_table, materialize

K1, B = 1.5, 0.75
#: Terms of one search that are broadcast and pushed to the scan of the postings; more of them are joined by shuffle.
FEW_TERMS = 10_000


@dataclass
class Index:
    """postings(doc_id, term, tf, dl), dfs(term, df), stats(n, avgdl) with one row, docs(doc_id, dl)."""

    postings: DataFrame
    dfs: DataFrame
    stats: DataFrame
    docs: DataFrame
    #: doc_id, dl, tokens, where the index is not stored: a search then counts the asked terms only
    tokens: DataFrame | None = None

    def stored(self, label: str = "index") -> Index:
        """The index written to the shared folder, once for many queries.

        Postings lie in ranges of terms (a frequent one over several), sorted, so a search reads the row groups of the
        asked terms only.
        """
        parts = int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        postings = materialize(self.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id"), label)
        dfs = postings.groupBy("term").agg(F.count("*").alias("df"))
        dfs = materialize(dfs.repartitionByRange(max(parts // 8, 1), "term").sortWithinPartitions("term"), label)
        return Index(postings, dfs, *(materialize(x, label) for x in (self.stats, self.docs)))

    def asked(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """postings and dfs of the asked terms. Without a stored index they are counted from the tokens that match."""
        words = getattr(terms, "_words", None)
        few = words is not None and len(words) <= FEW_TERMS
        if self.tokens is None:
            if not few:
                return self.postings, self.dfs
            return tuple(x.where(F.col("term").isin(words)) for x in (self.postings, self.dfs))
        tokens = F.filter("tokens", lambda t: t.isin(words)) if few else F.col("tokens")
        hits = self.tokens.select("doc_id", "dl", F.explode(tokens).alias("term"))
        if not few:
            hits = hits.join(terms.select("term").distinct(), "term", "left_semi")
        hits = hits.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
        return hits, hits.groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Documents without tokens count in n and in the mean length; null texts are empty."""
    tokens = docs.select(F.col(key).alias("doc_id"), bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    sized = tokens.withColumn("dl", F.size("tokens").cast("bigint"))
    postings = (
        sized.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    )
    dfs = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = sized.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    return Index(postings, dfs, stats, sized.select("doc_id", "dl"), sized)


_warm: dict[tuple, Index] = {}


def warm_index(docs: DataFrame, name: str, version: str, key: str = "doc_id", text: str = "text") -> Index:
    """The stored index of a corpus, built by the first query of an application that needs it.

    It is rebuilt when version changes (see sources.tables.version); the older one is deleted.
    """
    at = (docs.sparkSession.sparkContext.applicationId, name)
    known = _warm.get(at)
    if known is None or known[0] != version:
        if known is not None:
            for table in (known[1].postings, known[1].dfs, known[1].stats, known[1].docs):
                drop_table(table)
        _warm[at] = (version, build_index(docs, key, text).stored())
    return _warm[at][1]


def words_of(query: str) -> list[str]:
    """As bm25_tokens, for the few words of a question on the driver."""
    return re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower())


def query_terms(spark: SparkSession, queries: list[str] | dict[int, str]) -> DataFrame:
    """query_id, term, weight: a term repeated in a query counts as often. The queries are the caller's, a few lines."""
    asked = queries if isinstance(queries, dict) else dict(enumerate(queries))
    rows = [(i, term, n) for i, query in asked.items() for term, n in sorted(Counter(words_of(query)).items())]
    terms = spark.createDataFrame(rows, "query_id int, term string, weight bigint")
    terms._words = sorted({term for _, term, _ in rows})
    return terms


def score(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, score of documents that hold a term; only the postings of the asked terms are aggregated."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    postings, dfs = index.asked(terms)
    # one row of statistics; the terms of a search are broadcast up to FEW_TERMS
    asked = terms.join(dfs, "term").crossJoin(F.broadcast(index.stats)).withColumn("idf", idf)
    few = len(getattr(terms, "_words", ())) <= FEW_TERMS and hasattr(terms, "_words")
    return (
        postings.join(F.broadcast(asked) if few else asked, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("idf") * part).alias("score"))
    )


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: str = "doc_id", best: Column | None = None) -> DataFrame:
    """The k best rows of each query with their 0-based rank; ties by the order column.

    The comparison stands on the row number itself: so Spark keeps k rows of a query in every task before the shuffle.
    """
    w = Window.partitionBy(by).orderBy(F.desc("score") if best is None else best.desc(), F.asc(order))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("rank", F.col("place") - 1).drop("place")


def search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    return top_k(score(index, terms), k)


def fetch_size(k: int) -> int:
    return max(8 * k, 20)


def with_rest(index: Index, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """found (query_id, doc_id, score, rank) with documents of score 0 behind, in key order, up to k a query of asked."""
    have = found.groupBy("query_id").agg(F.count("*").alias("have"))
    # the first 2k keys hold at least k without a score, as at most k have one
    first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    missing = asked.crossJoin(F.broadcast(first)).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("doc_id")
    rest = missing.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(have, "query_id", "left")
    rest = rest.withColumn("rank", (F.col("place") - 1 + F.coalesce("have", F.lit(0))).cast("int"))
    rest = rest.where(F.col("rank") < k).select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank")
    return found.select("query_id", "doc_id", "score", "rank").unionByName(rest)


def padded(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """As search, but documents of score 0 follow in key order where fewer than k hold a term."""
    return with_rest(index, search(index, terms, k), terms.select("query_id").distinct(), k)


def statistics(index: Index) -> DataFrame:
    sizes = index.postings.agg(F.sum("tf").alias("tokens"), F.count_distinct("term").alias("terms"))
    return index.stats.crossJoin(F.broadcast(sizes))


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank of a 0-based rank."""
    return F.lit(1.0) / (k + rank)
