"""Packing retrieved chunks and chat turns into a model's budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, query_tokens, rough_tokens

CONTEXT_TOKENS, PROMPT_RESERVE, LEAST_BUDGET, LEAST_ROOM = 4096, 700, 600, 80
HISTORY_TOKENS, HISTORY_SHARE = 4096, 0.8
# fixed values: marks of left-out lines and of a cut text
GAP = "    # ..."
TRUNCATED = "\n# [... truncated for context budget]"


def relevant_lines(content: Column, tokens: Column, around: int = 3) -> Column:
    """Lines within around of one that holds a token, a mark for each gap; the content itself if that saves under 15 %."""

    def bind(value: Column, then: Callable[[Column], Column]) -> Column:
        """then(value) with value computed once: lambdas have no common subexpressions."""
        return F.transform(F.array(value), then)[0]

    def found(rows: Column) -> Column:
        marked = F.transform(rows, lambda x, i: F.when(F.arrays_overlap(query_tokens(x), tokens), i))
        return bind(F.array_compact(marked), lambda hits: near(rows, hits))

    def near(rows: Column, hits: Column) -> Column:
        kept = F.transform(rows, lambda x, i: F.exists(hits, lambda h: F.abs(h - i) <= around))
        return bind(kept, lambda keep: bind(joined(rows, keep), lambda cut: chosen(rows, hits, cut)))

    def joined(rows: Column, keep: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            fresh = (i == 0) | F.get(keep, F.greatest(i - 1, F.lit(0)))
            return F.when(F.get(keep, i), x).when(fresh, F.lit(GAP))

        return F.array_join(F.array_compact(F.transform(rows, piece)), "\n")

    def chosen(rows: Column, hits: Column, cut: Column) -> Column:
        stays = (F.size(rows) <= 6) | (F.size(hits) == 0) | (F.length(cut) >= 0.85 * F.length(content))
        return F.when(stays, content).otherwise(cut)

    return F.when(F.size(tokens) == 0, content).otherwise(bind(lines(content), found))


def budget(query: Column) -> Column:
    return F.greatest(F.lit(CONTEXT_TOKENS - PROMPT_RESERVE) - rough_tokens(query), F.lit(LEAST_BUDGET))


def pack(ranked: DataFrame, by: str = "query_id", text: str = "content", room: Column | None = None) -> DataFrame:
    """Rows of (by, rank, content) that fit the budget in rank order, with tokens and packed text; rank is unique in by.

    The first that does not fit is cut to what is left, if that is more than 80 tokens, and ends the list. Every row has a
    token at least, so no more rows than the largest budget has tokens can matter: that many leave each task. The sums run
    over sizes only; the texts are joined to the rows that stay.
    """
    most = CONTEXT_TOKENS - PROMPT_RESERVE
    sized = ranked.select(by, "rank", rough_tokens(F.col(text)).alias("tokens"), (F.lit(most) if room is None else room).alias("room"))
    first = Window.partitionBy(by).orderBy("rank")
    sized = sized.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most + 1)
    w = first.rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("upto", F.sum("tokens").over(w))
    fits = F.col("upto") <= F.col("room")
    # the list ends at the first row that does not fit
    over = F.sum((~fits).cast("int")).over(w)
    left = F.col("room") - (F.col("upto") - F.col("tokens"))
    kept = summed.withColumn("over", over).where((F.col("over") == 0) | ((F.col("over") == 1) & ~fits & (left > LEAST_ROOM)))
    kept = kept.select(by, "rank", "tokens", F.when(F.col("over") > 0, left).alias("left"))
    cut = F.concat(F.substr(F.col(text), F.lit(1), (F.col("left") * 3).cast("int")), F.lit(TRUNCATED))
    kept = kept.withColumnsRenamed({by: "_by", "rank": "_rank"})
    found = ranked.join(kept, F.col(by).eqNullSafe(F.col("_by")) & (F.col("rank") == F.col("_rank"))).drop("_by", "_rank")
    return found.withColumn("packed", F.when(F.col("left").isNull(), F.col(text)).otherwise(cut)).drop("left")


def format_chunk(path: Column, first: Column, last: Column, kind: Column, name: Column, language: Column, body: Column) -> Column:
    """A chunk under its place and name, fenced."""
    place = F.concat(F.lit("### "), path, F.lit(" (lines "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(")"))
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" — "), F.coalesce(kind, F.lit("block")), F.lit(": `"), name, F.lit("`"))).otherwise("")
    return F.concat(place, named, F.lit("\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n```"))


def build_context(ranked: DataFrame, by: str = "query_id", query: str = "query") -> DataFrame:
    """by, context, sources of ranked chunks with the question each row answers: the packed chunks, best last, under a line
    with the number of files.

    ranked has by, rank, query, file_path, start_line, end_line, chunk_type, name, language, content; each question filters
    and budgets its own chunks, by the size of what is shown of them.
    """
    columns = (F.col(c) for c in ("file_path", "start_line", "end_line", "chunk_type", "name", "language"))
    body = relevant_lines(F.coalesce("content", F.lit("")), query_tokens(F.col(query)))
    shown = ranked.select(by, "rank", "file_path", F.col(query).alias("question"), format_chunk(*columns, body).alias("content"))
    packed = pack(shown, by, room=budget(F.col("question")))
    # a budget of tokens bounds what one group collects
    grouped = packed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("packed").alias("body"), "file_path")), asc=False).alias("parts"))
    sources = F.array_distinct(F.reverse(F.transform("parts", lambda p: p["file_path"])))
    head = F.concat(F.lit("# Code context from "), F.size(sources).cast("string"), F.lit(" file(s)\n"))
    return grouped.select(by, F.concat(head, F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n")).alias("context"), sources.alias("sources"))


def trim_history(turns: DataFrame, max_tokens: int = HISTORY_TOKENS, reserve: int = 1024, base_chars: int = 0) -> DataFrame:
    """Newest turns of (conv_id, turn, role, content) that fit; the oldest go in pairs, all of them if need be."""
    limit = int((max_tokens - reserve) * HISTORY_SHARE)
    order = Window.partitionBy("conv_id").orderBy("turn")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    sized = turns.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "suffix", F.sum(F.coalesce(F.length("content"), F.lit(0))).over(rest)
    )
    fits = (F.col("place") % 2 == 0) & (F.floor((F.col("suffix") + base_chars) / 3) <= limit)
    first = F.min(F.when(fits, F.col("place"))).over(Window.partitionBy("conv_id"))
    return sized.withColumn("first", first).where(F.col("place") >= F.col("first")).drop("place", "suffix", "first")


def last_turns(turns: DataFrame, n: int = 12, clip: int | None = None) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")
    return kept if clip is None else kept.withColumn("content", F.substring("content", 1, clip))


# fixed values: tasks a prompt can be built for
TASKS = {
    "explain": "Explain the code in the context: what it does, how, and which details matter. Name only code that is shown.",
    "review": "Review the code in the context. List each finding with severity, file, line, problem and remedy, worst first.",
    "generate": "Write code in the style of the context. Give only code, and use nothing that the context does not show.",
    "debug": "Find the cause of the error in the context: quote the lines, then give the corrected code and the reason.",
    "general": "Answer from the code in the context only, and say so where it does not hold the answer.",
    "chat": "Go on with the conversation about the code in the context, in a few sentences.",
}


# fixed values: tokens of an answer by task
ANSWER_TOKENS = {"explain": 1500, "review": 1500, "generate": 2048, "debug": 1200, "general": 1024, "chat": 800}
#: What stands before a question for which no code was found.
NO_CONTEXT = "(The index holds no code for this question: answer from general knowledge, and say that it is not from this code base.)"


def build_prompt(task: Column, query: Column, context: Column, sources: Column, extra: Column | None = None) -> Column:
    """struct(system, user, max_tokens): the task's instruction (general for unknown ones) with an extra one behind it, up to
    six sources, the context, the question; a note instead where the context is null."""
    known = F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair])
    limits = F.create_map(*[F.lit(x) for pair in ANSWER_TOKENS.items() for x in pair])
    listed = F.array_join(F.transform(F.slice(sources, 1, 6), lambda s: F.concat(F.lit("  - "), s)), "\n")
    system = F.coalesce(F.try_element_at(known, task), F.lit(TASKS["general"]))
    if extra is not None:
        system = F.when(F.length(extra) > 0, F.concat(system, F.lit("\n"), extra)).otherwise(system)
    note = F.when(F.size(sources) > 0, F.concat(F.lit("\nSource files used:\n"), listed, F.lit("\n"))).otherwise("")
    found = F.when(F.length(context) > 0, F.concat(note, F.lit("\n"), context, F.lit("\n\n---\n\n"), query)).otherwise(query)
    user = F.when(context.isNull(), F.concat(F.lit(NO_CONTEXT + "\n\n"), query)).otherwise(found)
    return F.struct(system.alias("system"), user.alias("user"), F.coalesce(F.try_element_at(limits, task), F.lit(1024)).alias("max_tokens"))


def compress_chunks(chunks: DataFrame, compress: Callable[[str, str], str], question: str, first: int = 3, least: int = 400) -> DataFrame:
    """The first chunks by rank cut to what a function of (question, content) gives, a bounded few per question.

    Contents under 400 characters and answers of 20 or fewer stay as they are, also where the function fails.
    """

    @F.pandas_udf("string")
    def shorter(contents: pd.Series) -> pd.Series:
        def one(content: str | None) -> str | None:
            try:
                found = (compress(question, content) or "").strip()
            except Exception:  # the function is the caller's; whatever it raises, the content stays
                return content
            return found if len(found) > 20 else content

        return contents.map(one)

    picked = (F.col("rank") < first) & (F.length("content") >= least)
    done = chunks.where(picked).withColumn("short", shorter("content"))
    changed = ~F.col("short").eqNullSafe(F.col("content"))
    done = done.withColumn("context_header", F.when(changed, F.concat(F.coalesce("context_header", F.lit("")), F.lit(" [compressed]"))).otherwise(F.col("context_header")))
    return chunks.where(~F.coalesce(picked, F.lit(False))).unionByName(done.withColumn("content", F.col("short")).drop("short"))


def faithfulness(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """answers (question, context, answer) with grounded and unsupported: identifiers of the answer that its context lacks.

    A deterministic stand-in for a model's judgement: an answer is faithful if at least half of its identifiers of four or
    more characters, or none of them, stand in the first 2,000 characters of the context or in the question.
    """
    words = F.array_distinct(F.regexp_extract_all(F.substring("answer", 1, 1000), F.lit(r"[A-Za-z_]\w*(?:[A-Z_]\w*)"), F.lit(0)))
    named = F.filter(words, lambda w: F.length(w) > 3)
    known = F.concat(F.substring("context", 1, 2000), F.lit(" "), F.col("question"))
    missing = F.filter(named, lambda w: ~F.contains(known, w))
    share = 1 - F.size(missing) / F.greatest(F.size(named), F.lit(1))
    return answers.withColumn("unsupported", missing).withColumn("confidence", share).withColumn("is_faithful", share >= least)
