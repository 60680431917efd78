"""Queries of the core operators, by name; sql.py has what DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, lexical, pipeline, retrieval, scan, store, vectors
from ..session import drop_table, materialize
from ..sources import tree
from ..sources.tables import table, version

Query = Callable[[SparkSession, str], DataFrame]

# fixed values: the eight benchmark questions
QUESTIONS = [
    "authenticate user password jwt",
    "database connection pool retry",
    "cache invalidation eviction",
    "order payment billing process",
    "batch operations bulk insert",
    "health check status endpoint",
    "shutdown close cleanup graceful",
    "validate config host port timeout",
]
TERMS = ["retry", "cache", "TODO", "ledger"]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return scan.latest(table(spark, folder, "files"), ["repo_id", "relative_path"], ["loaded_at", "size_bytes"])


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return store.last_write(table(spark, folder, "chunks"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def _asked(spark: SparkSession) -> DataFrame:
    return lexical.query_terms(spark, QUESTIONS)


def _docs_index(spark: SparkSession, folder: str) -> lexical.Index:
    return lexical.warm_index(_docs(spark, folder), f"{folder}/documents", version(spark, folder, "documents"))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The newest chunks, with paths that tell repositories apart."""
    return _chunks(spark, folder).withColumn("file_path", F.concat_ws("/", "repo_id", "file_path"))


def _chunk_index(spark: SparkSession, folder: str) -> lexical.Index:
    return lexical.warm_index(_chunks(spark, folder), f"{folder}/chunks", version(spark, folder, "chunks"), "ord", "content")


_vectors: dict[tuple, tuple] = {}


def _chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """ord, embedding of the newest chunks, computed by the first query of an application that needs them."""
    at, now = (spark.sparkContext.applicationId, folder), version(spark, folder, "chunks")
    known = _vectors.get(at)
    if known is None or known[0] != now:
        if known is not None:
            drop_table(known[1])
        chunks = _chunks(spark, folder)
        _vectors[at] = (now, materialize(chunks.select("ord", vectors.embed(chunking.embedding_text(chunks)).alias("embedding")), "embeddings"))
    return _vectors[at][1]


def _corpus(spark: SparkSession, folder: str) -> pipeline.Corpus:
    files = _files(spark, folder).select(F.concat_ws("/", "repo_id", "relative_path").alias("file_path"), "content")
    return pipeline.Corpus(files, _numbered(spark, folder), _chunk_index(spark, folder), _chunk_vectors(spark, folder), lambda q: vectors.hashed_embeddings([q])[0].tolist())


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.search(_docs_index(spark, folder), _asked(spark), 5)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_cold(spark: SparkSession, folder: str) -> DataFrame:
    """The same without a stored index: the asked terms are counted in one pass."""
    found = lexical.search(lexical.build_index(_docs(spark, folder)), _asked(spark), 5)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_chunks_topk(spark: SparkSession, folder: str) -> DataFrame:
    terms = lexical.query_terms(spark, ["retry ledger cache", "parse token stream", "getUserById order"])
    found = lexical.search(_chunk_index(spark, folder), terms, 5).withColumnRenamed("doc_id", "ord")
    named = _chunks(spark, folder).select("ord", "id").join(F.broadcast(found), "ord")
    return named.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def bm25_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = lexical.statistics(_docs_index(spark, folder))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), "tokens", "terms")


def bm25_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return _docs_index(spark, folder).dfs.select("term", "df")


def bm25_padded(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.padded(_docs_index(spark, folder), lexical.query_terms(spark, ["zzqx pump", "qqqqxx"]), lexical.fetch_size(2))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    both = lexical.search(_docs_index(spark, folder), lexical.query_terms(spark, ["ledger meter", "pump ledger cache"]), 40)
    weight = F.when(F.col("query_id") == 0, retrieval.VECTOR_WEIGHT).otherwise(retrieval.LEXICAL_WEIGHT)
    # both lists of the request come from one search
    fused = both.select("doc_id", (lexical.rrf(F.col("rank")) * weight).alias("part")).groupBy("doc_id").agg(F.sum("part").alias("score"))
    found = lexical.top_k(fused.withColumn("query_id", F.lit(0)), 10, best=F.round("score", 12))
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def file_scoped_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).where(retrieval.path_filter(F.col("source"), "wiki\\"))
    index = lexical.build_index(docs)
    found = lexical.search(index, lexical.query_terms(spark, ["ledger meter"]), 24)
    out = retrieval.hybrid(found, found, 5, corpus=docs, file_scoped=True)
    return out.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


#: A request as a planner might give it.
REQUEST = pipeline.Plan(
    "where is the ledger retried when the cache fails", "ledger retry cache", ["ledger", "retry"], task="explain", literal_terms=["retryLedger"],
    variants=["ledger retry cache", "pump ledger", "meter cache"], hypothetical_answer="def retry_ledger(cache):\n    return ledger.retry(cache)",
)


def multi_strategy(spark: SparkSession, folder: str) -> DataFrame:
    scored = pipeline.multi_strategy_scores(_corpus(spark, folder), REQUEST, 4).withColumn("query_id", F.lit(0))
    kept = retrieval.cut_low(scored.withColumn("score", F.round("score", 4)), 4)
    return kept.select("doc_id", "score")


def multi_strategy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = pipeline.rag_chunks(_corpus(spark, folder), REQUEST, 4)
    return found.select("id", "score", "rank")


def pipeline_chunks(spark: SparkSession, folder: str) -> DataFrame:
    _, found = pipeline.run_pipeline(_corpus(spark, folder), PIPELINE_QUESTION, 5)
    return found.select("id", "chunk_type", "start_line", F.round("score", 3).alias("score"), "rank")


def pipeline_context(spark: SparkSession, folder: str) -> DataFrame:
    plan, found = pipeline.run_pipeline(_corpus(spark, folder), PIPELINE_QUESTION, 5)
    return pipeline.prompt_of(found, plan).select("context", "sources", "user", "max_tokens", "tokens")


PIPELINE_QUESTION = "where does ledger retry the cache shipment"


def percentile_cut(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("r", F.row_number().over(w)).where("r <= 50").drop("r")
    return retrieval.cut_low(best, 5).select("query_id", "doc_id", "score")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = vectors.cosine_top_k(rows.where("vec_id % 20 = 0"), rows, 4)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(retrieval.compile_filter({"$or": [{"label": 1}, {"label": 2}]}))
    found = vectors.cosine_top_k(rows.where("vec_id % 20 = 0"), rows, 3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    a = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = rows.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", F.round(vectors.cosine("x", "y"), 6).alias("cosine"))


def hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    found = chunks.select("id", F.posexplode(vectors.embed(chunking.embedding_text(chunks))).alias("place", "value"))
    return found.where("value <> 0").select("id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


def hybrid_chunks(spark: SparkSession, folder: str) -> DataFrame:
    corpus = _corpus(spark, folder)
    near = pipeline._near(corpus, dict(enumerate(QUESTIONS)), 40)
    found = retrieval.hybrid(near, lexical.search(corpus.index, _asked(spark), 40).select("query_id", "doc_id", "rank"), 5)
    named = corpus.chunks.select(F.col("ord").alias("doc_id"), "id").join(F.broadcast(found), "doc_id")
    return named.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def vector_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = vectors.VectorIndex(rows).search(rows.where("vec_id % 20 = 0"), 4)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def scan_selected(spark: SparkSession, folder: str) -> DataFrame:
    return scan.select_files(_files(spark, folder)).select("repo_id", "relative_path", "file_language")


def scan_frontend(spark: SparkSession, folder: str) -> DataFrame:
    kept = scan.select_files(_files(spark, folder), profile="frontend", skip_dirs=["test"], max_kb=4)
    return kept.select("repo_id", "relative_path", "file_language")


def scan_ignored(spark: SparkSession, folder: str) -> DataFrame:
    return scan.select_files(_files(spark, folder), ignore=["*.json", "!*_branch.json", "/apps", "minify/"]).select("repo_id", "relative_path")


def scan_changed(spark: SparkSession, folder: str) -> DataFrame:
    found = scan.changed_files(_files(spark, folder), table(spark, folder, "file_state"))
    return found.select("repo_id", "relative_path", "content_hash")


def scan_deleted(spark: SparkSession, folder: str) -> DataFrame:
    return scan.deleted_files(_files(spark, folder), table(spark, folder, "file_state"))


def scan_diff(spark: SparkSession, folder: str) -> DataFrame:
    return scan.diff_counts(_files(spark, folder), table(spark, folder, "file_state"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return files.select("repo_id", "relative_path", F.sha1("content").alias("sha1"), F.sha1("content").eqNullSafe(F.col("content_hash")).alias("agrees"))


def hash_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return store.snapshot(_files(spark, folder))


def repo_roots(spark: SparkSession, folder: str) -> DataFrame:
    return tree.repo_roots(_files(spark, folder))


def chunks_without_repo(spark: SparkSession, folder: str) -> DataFrame:
    return store.delete_repo(_chunks(spark, folder), "7154cf61b6b9").select("id")


def named_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as they are shown to a model, by their hash."""
    columns = (F.col(c) for c in ("file_path", "start_line", "end_line", "chunk_type", "name", "language", "content"))
    return _chunks(spark, folder).select("id", F.sha1(context.format_chunk(*columns)).alias("sha1"))


def repo_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "repos").select("repo_id", scan.repo_id(F.col("root_path")).alias("derived"))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return chunks.select("id", scan.chunk_id(F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("derived"))


def folder_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return scan.folder_stats(_files(spark, folder))


def area_plan(spark: SparkSession, folder: str) -> DataFrame:
    return scan.plan_areas(_files(spark, folder))


def repo_types(spark: SparkSession, folder: str) -> DataFrame:
    return scan.repo_type(scan.plan_areas(_files(spark, folder)))


def folder_batches(spark: SparkSession, folder: str) -> DataFrame:
    return scan.folder_batches(_files(spark, folder))


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).where(F.length("text") > 0)
    part = docs.select("doc_id", F.explode(chunking.line_windows(F.col("text"))).alias("w"))
    return part.select("doc_id", "w.start_line", "w.end_line", F.length("w.content").alias("chars"))


def window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = chunking.window_chunks(_files(spark, folder))
    return found.select("id", "start_line", "end_line", F.sha1("content").alias("sha1"))


def python_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.python_chunks(_files(spark, folder))


def chunked_files(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_files(_files(spark, folder)).select("id", "chunk_type", "name", "context_header", "start_line", "end_line")


def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return chunks.select("id", F.sha1(chunking.embedding_text(chunks)).alias("sha1"))


def chunk_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_statistics(_chunks(spark, folder))


def chunk_types(spark: SparkSession, folder: str) -> DataFrame:
    grouped = _chunks(spark, folder).groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum(F.when(F.coalesce("name", F.lit("")) != "", 1).otherwise(0)).alias("named"))
    return grouped.withColumn("share", F.round(100 * F.col("named") / F.col("chunks"), 4))


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("id", "ord", "indexed_at")


def upserted_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("id", "ord", "language")
    old = scan.latest(chunks.where("ord % 3 <> 0"), ["id"], ["ord"])
    new = scan.latest(chunks.where("ord % 3 = 0"), ["id"], ["ord"])
    return store.upsert(old, new)


def chunks_without_deleted(spark: SparkSession, folder: str) -> DataFrame:
    gone = scan.changed_files(_files(spark, folder), table(spark, folder, "file_state"))
    return store.delete_files(_chunks(spark, folder), gone).select("id")


def chunks_to_embed(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return store.not_stored(chunks, chunks.where("ord % 2 = 0")).select("id", "ord")


def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return store.with_defaults(store.lookup(chunks, chunks.where("language = 'go'")))


def repo_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where(store.metadata_filter(language="python")).groupBy("repo_id").agg(F.count("*").alias("chunks"))


def filter_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    where = {"$and": [{"language": "java"}, {"$or": [{"chunk_type": "class_declaration"}, {"chunk_type": "block"}]}]}
    return _chunks(spark, folder).where(retrieval.compile_filter(where)).select("id", "chunk_type")


def symbol_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return store.symbol_vocabulary(_chunks(spark, folder))


def grep_lines(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).withColumn("file_path", F.concat_ws("/", "repo_id", "relative_path"))
    found = retrieval.grep(retrieval.file_lines(files.where("content IS NOT NULL")), TERMS)
    return found.select("file_path", "line_number", "term")


def grep_windows(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder).withColumn("file_path", F.concat_ws("/", "repo_id", "relative_path")).where("content IS NOT NULL")
    found = retrieval.grep(retrieval.file_lines(files), TERMS)
    return retrieval.grep_windows(found, files).select("id", "start_line", "end_line", "name", F.sha1("content").alias("sha1"))


def plan_text(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    return scan.format_analysis(scan.plan_areas(files), files)


def _spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _chunks(spark, folder).select("file_path", "start_line", "id", ((F.col("ord") % 97) / 97.0).alias("score"), "ord")
    return rows.where("ord % 3 = 0"), rows.where("ord % 3 <> 0")


def merged_spans(spark: SparkSession, folder: str) -> DataFrame:
    literal, semantic = _spans(spark, folder)
    found = retrieval.merge_spans(literal, semantic, ["vendor", "core"])
    return found.select("file_path", "bucket", "id", "start_line", F.round("score", 6).alias("score"))


def diversified(spark: SparkSession, folder: str) -> DataFrame:
    literal, _ = _spans(spark, folder)
    return retrieval.diversified(literal).select("id", F.round("score", 9).alias("score"))


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder).withColumn("score", (F.col("ord") % 97) / 97.0)
    return retrieval.rerank(chunks, "how does retryLedger handle a cache", ["ledger", "cache"], 20).select("id", "score", "rank")


def packed_context(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _docs(spark, folder).select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.coalesce("text", F.lit("")).alias("content"))
    return context.pack(ranked).select("query_id", "rank", "tokens", F.length("packed").alias("chars"))


def built_context(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.search(_docs_index(spark, folder), _asked(spark), 5)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")
    ranked = _docs(spark, folder).join(F.broadcast(found), "doc_id").join(F.broadcast(questions), "query_id").select(
        "query_id", "query", "rank", F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.size(T.lines(F.col("text"))).alias("end_line"),
        F.lit("block").alias("chunk_type"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("language"), F.col("text").alias("content"),
    )
    return context.build_context(ranked)


def relevant_lines(spark: SparkSession, folder: str) -> DataFrame:
    tokens = T.query_tokens(F.lit("ledger cache retry"))
    docs = _docs(spark, folder).where(F.length("text") > 0)
    return docs.select("doc_id", F.sha1(context.relevant_lines(F.col("text"), tokens)).alias("sha1"))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "history").groupBy("conv_id", "turn").agg(F.max(F.struct("role", "content")).alias("row")).select("conv_id", "turn", "row.*")


def trimmed_history(spark: SparkSession, folder: str) -> DataFrame:
    return context.trim_history(_history(spark, folder), max_tokens=1500).select("conv_id", "turn", "role")


def last_turns(spark: SparkSession, folder: str) -> DataFrame:
    return context.last_turns(_history(spark, folder), 3, clip=200).select("conv_id", "turn", "content")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    turns = _history(spark, folder).where("content IS NOT NULL")
    built = context.build_prompt(F.when(F.col("turn") % 2 == 0, "review").otherwise("other"), F.col("content"), F.lit("x = 1"), F.array(F.col("role")))
    return turns.select("conv_id", "turn", built.alias("p")).select("conv_id", "turn", "p.*")


def split_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    names = _chunks(spark, folder).where("name IS NOT NULL")
    return names.select("id", T.snake_split(T.camel_split(F.col("name"))).alias("words"))


def tokenized(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _docs(spark, folder).select("doc_id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("terms"))


def rough_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text IS NOT NULL").select("doc_id", T.rough_tokens(F.col("text")).alias("tokens"))


def corrected_queries(spark: SparkSession, folder: str) -> DataFrame:
    turns = _history(spark, folder).where("content IS NOT NULL")
    fixed = turns.select("conv_id", "turn", T.correct_query(F.col("content")).alias("q"))
    return fixed.select("conv_id", "turn", "q.corrected", F.array_join("q.symbols", " ").alias("symbols"), F.array_join("q.changes", "; ").alias("changes"))


def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return table(spark, folder, "events").groupBy(parsed["k"].alias("k")).agg(F.count("*").alias("events"))


def embedding_rate(spark: SparkSession, folder: str) -> DataFrame:
    found = store.rolling_rate(table(spark, folder, "events"), "event_type")
    return found.select("event_type", "nth", F.round("rate", 9).alias("rate"))


def folder_eta(spark: SparkSession, folder: str) -> DataFrame:
    times = table(spark, folder, "events").where("value IS NOT NULL").select(F.col("event_type").alias("run"), "event_id", F.col("value").alias("seconds"))
    return store.folder_eta(times, "event_id", "seconds").select("run", "event_id", F.round("eta", -1).alias("eta"))


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


def nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_cold, bm25_chunks_topk, bm25_statistics, bm25_document_frequency, bm25_padded, rrf_fusion, file_scoped_retrieval, multi_strategy, multi_strategy_chunks, pipeline_chunks, pipeline_context, vector_index, plan_text,
        percentile_cut, vector_topk, vector_filtered, cosine_pairs, hashed_embeddings, hybrid_chunks, scan_selected, scan_frontend, scan_ignored,
        scan_changed, scan_deleted, scan_diff, content_hashes, hash_snapshot, repo_roots, chunks_without_repo, named_chunks, repo_ids, chunk_ids, folder_statistics, area_plan, repo_types, folder_batches,
        line_windows, window_chunks, python_chunks, chunked_files, embedding_texts, chunk_statistics, chunk_types, latest_chunks, upserted_chunks,
        chunks_without_deleted, chunks_to_embed, chunk_lookup, repo_filtered, filter_dictionary, symbol_vocabulary, grep_lines, grep_windows,
        merged_spans, diversified, reranked, packed_context, built_context, relevant_lines, trimmed_history, last_turns, prompts, split_identifiers,
        tokenized, rough_token_counts, corrected_queries, json_properties, embedding_rate, folder_eta, priced_lines, nation_orders,
    )
}
