"""Question to prompt: planning, literal and semantic search, merging, reranking, context.

What a language model does in between (a plan of the question, a shorter chunk, a judgement of the answer) comes in as a
function of the caller's; without one, or where it fails, a deterministic rule takes its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import context, lexical, retrieval, vectors

TASKS = tuple(context.TASKS)
#: Weights of the lists of a request: an answer made up beforehand, the lexical and the literal one.
ANSWER, LEXICAL, LITERAL = 1.5, 0.8, 1.2
#: Weights of the first and of the further questions within the lexical list.
FIRST_QUESTION, OTHER_QUESTION = 0.8, 0.5
MOST_FETCHED = 100

Planner = Callable[[str], dict]


@dataclass
class Plan:
    """What is searched for: literal terms, a question for the semantic search, parts of file names, the task."""

    question: str
    semantic_query: str
    search_terms: list[str] = field(default_factory=list)
    file_hints: list[str] = field(default_factory=list)
    task: str = "general"
    reasoning: str = ""
    corrected: str = ""
    changes: list[str] = field(default_factory=list)
    literal_terms: list[str] = field(default_factory=list)
    variants: list[str] = field(default_factory=list)
    sub_queries: list[str] = field(default_factory=list)
    hypothetical_answer: str = ""
    is_multi_hop: bool = False
    is_conversational: bool = False


def _answer(planner: Planner | None, prompt: str) -> dict | None:
    """The planner's dictionary; its text is read as JSON, with or without fences. None where it gives no such thing."""
    if planner is None:
        return None
    try:
        found = planner(prompt)
        if isinstance(found, str):
            found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", found.strip(), flags=re.M))
        return found if isinstance(found, dict) else None
    except Exception:  # the planner is the caller's: whatever it raises, the rule below takes over
        return None


def _once(items: list[str]) -> list[str]:
    return list(dict.fromkeys(x for x in items if x and x.strip()))


def _long_words(question: str) -> list[str]:
    return [w for w in question.split() if len(w) > 4][:3]


def analyse(question: str, planner: Planner | None = None) -> Plan:
    """A plan of five terms and three file hints at most; without a planner the first three words of five letters."""
    found = _answer(planner, question)
    if found is None:
        return Plan(question, question, _long_words(question), reasoning="fallback")
    return Plan(
        question, found.get("semantic_query", question), list(found.get("search_terms", []))[:5], list(found.get("file_hints", []))[:3],
        found.get("task", "general"), found.get("reasoning", ""),
    )


def understand(spark: SparkSession, question: str, history: list[dict] | None = None, planner: Planner | None = None, vocabulary: list[str] | None = None) -> Plan:
    """A plan with the question corrected, its names as literal terms, and its variants; the last six turns are shown to
    the planner, 200 characters of each."""
    row = spark.createDataFrame([(question,)], "q string")
    near = None
    if vocabulary:
        row = row.withColumn("near", T.nearest_names(vocabulary)(T.snake_split(T.camel_split(T.normalise_symbols(F.col("q"))))))
        near = F.col("near")
    fixed = row.select(T.correct_query(F.col("q"), near).alias("x")).first()["x"]
    working = fixed["corrected"]
    shown = working
    if history:
        turns = "\n".join(f"{m['role'].upper()}: {m['content'][:200]}" for m in history[-6:])
        shown = f"Conversation history:\n{turns}\n\nNew question: {working}"
    found = _answer(planner, shown)
    if found is None:
        terms = _once(fixed["symbols"] + _long_words(working))
        plan = Plan(question, working, terms[:5], reasoning="fallback", literal_terms=terms, variants=[working], sub_queries=[working])
    else:
        rewritten = found.get("reformulated", working)
        plan = Plan(
            question, rewritten, list(found.get("search_terms", []))[:5], list(found.get("file_hints", []))[:3], found.get("task", "general"), found.get("reasoning", ""),
            literal_terms=_once(list(found.get("search_terms", []))[:6] + fixed["symbols"]), variants=_once([rewritten, *list(found.get("query_variants", []))[:4], working]),
            sub_queries=list(found.get("sub_queries", [working])), hypothetical_answer=found.get("hypothetical_answer", ""), is_multi_hop=bool(found.get("is_multi_hop", False)),
        )
    return replace(plan, corrected=working, changes=list(fixed["changes"]), is_conversational=bool(history))


@dataclass
class Corpus:
    """files (file_path, content); chunks (ord, id, file_path, language, start_line, end_line, chunk_type, name,
    context_header, content), ord unique; the lexical index of the contents by ord; vectors (ord, embedding).

    embed gives the vector of a question; without it, or without vectors, the semantic search is lexical only.
    """

    files: DataFrame
    chunks: DataFrame
    index: lexical.Index
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None

    def filtered(self, where: Column) -> Corpus:
        """The corpus of the chunks that pass a predicate, with statistics of their own."""
        chunks = self.chunks.where(where)
        near = self.vectors.join(chunks.select("ord"), "ord", "left_semi") if self.vectors is not None else None
        return replace(self, chunks=chunks, index=lexical.build_index(chunks, "ord", "content"), vectors=near)


PAYLOAD = ["id", "file_path", "language", "start_line", "end_line", "chunk_type", "name", "context_header", "content"]


def _near(corpus: Corpus, questions: dict[int, str], k: int) -> DataFrame | None:
    """query_id, doc_id, rank of the k nearest chunks of each question; None where vectors or the function are missing."""
    if corpus.vectors is None or corpus.embed is None or not questions:
        return None
    spark = corpus.chunks.sparkSession
    rows = []
    for i, question in questions.items():
        try:
            rows.append((-i - 1, [float(x) for x in corpus.embed(question)]))
        except Exception:  # as with a planner: a question that cannot be embedded is left to the other lists
            continue
    asked = spark.createDataFrame([r for r in rows if r[1]], "ord bigint, embedding array<float>")
    found = vectors.cosine_top_k(asked, corpus.vectors, k, key="ord")
    return found.select((-F.col("query_id") - 1).cast("int").alias("query_id"), F.col("ord").alias("doc_id"), "rank")


def semantic_search(corpus: Corpus, question: str, k: int) -> DataFrame:
    """doc_id (the chunk's ord), score, rank of the k best by vectors and words together."""
    fetch = lexical.fetch_size(k)
    words = lexical.padded(corpus.index, lexical.query_terms(corpus.chunks.sparkSession, {0: question}), fetch).select("query_id", "doc_id", "rank")
    near = _near(corpus, {0: question}, min(fetch, MOST_FETCHED))
    lists = [(words, retrieval.LEXICAL_WEIGHT)] + ([(near, retrieval.VECTOR_WEIGHT)] if near is not None else [])
    return lexical.top_k(retrieval.fuse(lists), k, best=F.round("score", 12))


def literal_search(files: DataFrame, terms: list[str]) -> DataFrame:
    """Windows around the lines that hold a term, as chunks; place orders them by term, path and line."""
    found = retrieval.grep(retrieval.file_lines(files.where("content IS NOT NULL")), terms)
    windows = retrieval.grep_windows(found, files)
    language = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in GREP_LANGUAGES.items() for x in pair]), F.regexp_extract("file_path", r"\.[^./]*$", 0)), F.lit("text"))
    return windows.select(
        "id", "file_path", language.alias("language"), "start_line", "end_line", F.lit("grep_match").alias("chunk_type"), "name",
        F.concat(F.lit("grep:"), "name").alias("context_header"), "content", "score", F.struct(F.col("term_ord"), F.col("file_path").alias("path"), F.col("line_number").alias("line")).alias("place"),
    )


# fixed values: languages of the files a literal search looks into
GREP_LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".kt": "kotlin",
    ".cs": "c_sharp", ".rb": "ruby", ".cpp": "cpp", ".c": "c",
}
GREP_ENDINGS = [*GREP_LANGUAGES, ".scala", ".swift"]


def code_files(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("file_path", r"\.[^./]*$", 0).isin(GREP_ENDINGS))


def _merged(literal: DataFrame, semantic: DataFrame, hints: list[str]) -> DataFrame:
    """Chunks of both lists, one per file and bucket of lines, with score and ord: literal ones first, each in its order."""
    one = literal.select("file_path", "start_line", "id", "score", F.col("place").alias("ord"))
    two = semantic.select("file_path", "start_line", "id", "score", F.struct(F.col("rank").cast("int").alias("term_ord"), F.lit("").alias("path"), F.lit(0).alias("line")).alias("ord"))
    merged = retrieval.merge_spans(one, two, hints)
    payload = literal.select(*PAYLOAD).unionByName(semantic.select(*PAYLOAD))
    return merged.select("id", "score", "ord").join(payload, "id")


def run_pipeline(corpus: Corpus, question: str, top_k: int = 5, planner: Planner | None = None, task: str = "general") -> tuple[Plan, DataFrame]:
    """The plan, and the top_k chunks of literal and semantic search together, with score, ord and rank."""
    plan = analyse(question, planner)
    if task != "general":
        plan = replace(plan, task=task)
    literal = literal_search(code_files(corpus.files), plan.search_terms)
    found = semantic_search(corpus, plan.semantic_query, 2 * top_k)
    semantic = corpus.chunks.withColumnRenamed("ord", "doc_id").join(F.broadcast(found), "doc_id")
    merged = _merged(literal, semantic, plan.file_hints)
    return plan, retrieval.rerank(merged, question, plan.search_terms, top_k, plan.task)


def multi_strategy_scores(corpus: Corpus, plan: Plan, top_k: int = 5) -> DataFrame:
    """doc_id, score of the chunks that any list of the plan holds: the made-up answer and each variant by vectors, the
    questions by words in one list; all are found in one search of the index and one pass over the vectors.

    fetch_k is six times top_k, at most 100. The lexical list sums the scores of up to three questions, the first counting
    0.8 and the others 0.5, and goes on with chunks of score 0 by ord where there are too few.
    """
    fetch = min(6 * top_k, MOST_FETCHED)
    variants = plan.variants or [plan.semantic_query]
    asked = ({0: plan.hypothetical_answer} if plan.hypothetical_answer else {}) | {i + 1: v for i, v in enumerate(variants)}
    near = _near(corpus, asked, fetch)
    questions = _once([plan.semantic_query, *variants[:2]])
    terms = lexical.query_terms(corpus.chunks.sparkSession, dict(enumerate(questions)))
    weighted = F.when(F.col("query_id") == 0, FIRST_QUESTION).otherwise(OTHER_QUESTION)
    summed = lexical.score(corpus.index, terms).withColumn("score", F.col("score") * weighted)
    summed = summed.groupBy("doc_id").agg(F.sum("score").alias("score")).withColumn("query_id", F.lit(0))
    words = lexical.with_rest(corpus.index, lexical.top_k(summed, fetch, best=F.round("score", 9)), corpus.chunks.sparkSession.range(1).select(F.lit(0).alias("query_id")), fetch)
    parts = words.select("doc_id", (lexical.rrf(F.col("rank")) * LEXICAL).alias("part"))
    if near is not None:
        weights = F.when(F.col("query_id") == 0, ANSWER)
        for i in range(len(variants)):
            weights = weights.when(F.col("query_id") == i + 1, retrieval.strategy_weight(i))
        parts = parts.unionByName(near.select("doc_id", (lexical.rrf(F.col("rank")) * weights).alias("part")))
    return parts.groupBy("doc_id").agg(F.sum("part").alias("score"))


def multi_strategy_retrieve(corpus: Corpus, plan: Plan, top_k: int = 5, literal: bool = True) -> DataFrame:
    """Twice top_k chunks of all lists, the literal one with them, less the weakest fifth, reranked."""
    scored = multi_strategy_scores(corpus, plan, top_k)
    chunks = corpus.chunks.join(scored, F.col("ord") == F.col("doc_id")).select(*PAYLOAD, "score", F.struct(F.lit(0).alias("term_ord"), F.lit("").alias("path"), F.col("ord").alias("line")).alias("ord"))
    terms = [t for t in (plan.literal_terms or plan.search_terms) if t.strip()]
    if literal and terms:
        found = literal_search(code_files(corpus.files), terms)
        # only so many can come among the best, as each further one adds less than the one before
        first = lexical.top_k(found.select(F.lit(0).alias("query_id"), F.lit(0).alias("score"), "place", "id"), LITERAL_RANKS, order="place")
        ranked = found.join(F.broadcast(first.select("id", "rank")), "id").withColumn("score", lexical.rrf(F.col("rank")) * LITERAL)
        chunks = chunks.unionByName(ranked.select(*PAYLOAD, "score", F.struct(F.lit(1).alias("term_ord"), F.lit("").alias("path"), F.col("rank").cast("bigint").alias("line")).alias("ord")))
    rounded = chunks.withColumn("score", F.round("score", 4)).withColumn("query_id", F.lit(0))
    kept = retrieval.cut_low(rounded, top_k).drop("query_id")
    named = _once(plan.search_terms + plan.literal_terms) if plan.literal_terms else plan.search_terms
    return retrieval.rerank(kept, plan.question, named, 2 * top_k, plan.task)


#: Literal windows of one request that are ranked.
LITERAL_RANKS = 1_000


def rag_chunks(corpus: Corpus, plan: Plan, top_k: int = 5) -> DataFrame:
    """The top_k chunks of a second reranking over what the strategies found."""
    return retrieval.rerank(multi_strategy_retrieve(corpus, plan, top_k).drop("rank"), plan.question, plan.search_terms, top_k, plan.task)


def prompt_of(chunks: DataFrame, plan: Plan) -> DataFrame:
    """One row: context, sources, system, user, max_tokens, tokens; the no-context form where there are no chunks."""
    spark = chunks.sparkSession
    built = context.build_context(chunks.select(*PAYLOAD, "rank", F.lit(0).alias("query_id"), F.lit(plan.question).alias("query")))
    row = spark.range(1).select(F.lit(0).alias("query_id")).join(built, "query_id", "left")
    prompt = context.build_prompt(F.lit(plan.task), F.lit(plan.question), F.col("context"), F.coalesce("sources", F.array().cast("array<string>")))
    shown = row.select("context", "sources", prompt.alias("p")).select("context", "sources", "p.*")
    return shown.withColumn("tokens", T.rough_tokens(F.concat(F.coalesce("context", F.lit("")), "user")))
