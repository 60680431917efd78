"""Problem 3: cutting oversized chunks at natural boundaries, with overlap.

One bounded-quantifier regular expression is applied to a window of at most max_chars characters that starts where the
last piece, less its overlap, ended. Its alternatives are ordered by the strength of the boundary the piece ends at: a
closing line at the left margin or a blank line before one, a blank line, the end of a nested block, the end of a
statement, any line end, and last a cut between two characters. Each consumes as many lines as it can within the line
limit; a lookback over the piece's last lines gives the next start. The text is cut into lines once, and the fold over the
windows carries the number of the next line, so its time grows with the length of the text. It uses only SQL array and
string functions, so it stays in the JVM and each row is cut where it lies.

Defined results: null, empty and short contents give one piece (content unchanged, null for null); a line longer than
the limit is cut between characters, and then no lines are shared; repeated rows of an id with the same content give its
pieces once; line ends are \\n, \\r\\n or \\r and stay in the piece they end. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_CHARS, OVERLAP = 60, 2048, 10

_LINE = r"(?:[^\n\r]*+(?:\r\n|\n|\r(?!\n)))"
_LAST = r"(?:[^\n\r]++\z)"


def rest_pattern(max_lines: int = MAX_LINES) -> str:
    """A whole window within the line limit; tried first where the window reaches the text's end."""
    return rf"\A{_LINE}{{0,{max_lines - 1}}}(?:{_LINE}|{_LAST})\z"


def piece_pattern(max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> str:
    """The alternatives, strongest boundary first; each consumes more lines than any overlap, so every piece advances."""
    most = max_lines - 1
    half = max(overlap + 1, max_lines // 2)
    third = max(overlap + 1, max_lines // 3)
    end = r"(?:\r\n|\n|\r(?!\n))"
    return "|".join(
        (
            # a blank line, then text at the left margin
            rf"\A{_LINE}{{{third},{most}}}[ \t]*+{end}(?=[^\s])",
            # a line at the left margin that closes a block
            rf"\A{_LINE}{{{third},{most}}}[}})\]][^\n\r]*+{end}",
            # a blank line
            rf"\A{_LINE}{{{half},{most}}}[ \t]*+{end}",
            # the end of a nested block
            rf"\A{_LINE}{{{half},{most}}}[ \t]++[}})\]][^\n\r]*+{end}",
            # the end of a statement
            rf"\A{_LINE}{{{half},{most}}}[^\n\r]*+(?<=[;,:]){end}",
            # any line end
            rf"\A{_LINE}{{1,{max_lines}}}",
            # a window without line ends
            r"\A[\s\S]++",
        )
    )


def line_count(text: Column) -> Column:
    """Lines of a text: its line ends (\\n, \\r\\n or \\r), and one more if text follows the last of them."""

    def count(end: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(end), F.lit("")))

    ends = count("\n") + count("\r") - F.floor(count("\r\n") / 2)
    return (ends + F.when((text != "") & ~F.right(text, F.lit(1)).isin("\n", "\r"), 1).otherwise(0)).cast("int")


def is_oversized(text: Column, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> Column:
    return (F.length(text) > max_chars) | (line_count(text) > max_lines)


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: a one-element transform, as lambdas have no common subexpressions."""
    return F.transform(F.array(value), then)[0]


def _units(text: Column, max_chars: int) -> Column:
    """Lines with their ends; one that is longer than a piece in stretches of a piece's length, and its rest."""
    lines = F.regexp_extract_all(text, F.lit(rf"{_LINE}|{_LAST}"), F.lit(0))

    def cut(line: Column) -> Column:
        stretches = F.regexp_extract_all(line, F.lit(rf"(?s).{{1,{max_chars}}}"), F.lit(0))
        return F.when(F.length(line) > max_chars, stretches).otherwise(F.array(line))

    return F.flatten(F.transform(lines, cut))


def _fold(units: Column, max_lines: int, max_chars: int, overlap: int) -> Column:
    """Array of (line, content): the pieces of a text, given as its units, and the lines before each.

    The state is the number of the next unit, so a step costs what its window holds, wherever in the text it lies.
    """
    within = piece_pattern(max_lines, overlap)
    closing = rest_pattern(max_lines) + "|" + within
    total = F.size(units)

    def advance(state: Column, piece: Column) -> Column:
        lines = F.regexp_extract_all(piece, F.lit(_LINE), F.lit(0))
        ended = piece.rlike(r"[\n\r]\z")
        # a piece that ends inside a line is one unit, or the text's last lines
        return _bind(lines, lambda own: F.when(ended, after(state, piece, own, F.size(own))).otherwise(last(state, piece, F.size(own) + 1)))

    def last(state: Column, piece: Column, used: Column) -> Column:
        return state_of(state, piece, state["at"] + used, state["line"] + used - 1)

    def after(state: Column, piece: Column, own: Column, used: Column) -> Column:
        stop = state["at"] + used
        # the next line decides how many of the last lines still fit before it
        room = F.least(max_chars - F.length(F.coalesce(F.get(units, stop), F.lit(""))), F.length(piece) - 1)
        behind = F.reverse(F.slice(own, F.greatest(used - overlap + 1, F.lit(1)), F.lit(max(overlap, 1))))

        def take(found: Column, line: Column) -> Column:
            size = found["size"] + F.length(line)
            fits = found["open"] & (size <= room)
            return F.struct(F.when(fits, size).otherwise(found["size"]).alias("size"), (found["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(overlap > 0).alias("open"))
        return _bind(F.aggregate(behind, none, take)["n"], lambda shared: state_of(state, piece, F.when(stop >= total, stop).otherwise(stop - shared), state["line"] + used - shared))

    def state_of(state: Column, piece: Column, at: Column, line: Column) -> Column:
        found = F.concat(state["found"], F.array(F.struct(state["line"].alias("line"), piece.alias("content"))))
        return F.struct(at.cast("int").alias("at"), line.cast("int").alias("line"), found.alias("found"))

    def step(state: Column, _: Column) -> Column:
        joined = F.array_join(F.slice(units, state["at"] + 1, F.lit(max_lines)), "")
        # all that is left is in the window
        whole = (state["at"] + max_lines >= total) & (F.length(joined) <= max_chars)
        window = F.substr(joined, F.lit(1), F.lit(max_chars))
        piece = F.when(whole, F.regexp_extract(window, closing, 0)).otherwise(F.regexp_extract(window, within, 0))
        return F.when(state["at"] >= total, state).otherwise(_bind(piece, lambda found: advance(state, found)))

    empty = F.from_json(F.lit("[]"), "array<struct<line:int,content:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), empty.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), total), start, step, lambda state: state["found"])


def split_oversized(
    df: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """id, piece (from 1), pieces, start_line, end_line, content of each piece; start_line counts within the file."""
    text = F.col("content")
    rows = df.select("id", F.col("start_line").cast("int").alias("first_line"), "content")
    over = is_oversized(text, max_lines, max_chars)
    large = rows.where(over).dropDuplicates(["id", "content"])
    small = rows.where(~F.coalesce(over, F.lit(False))).dropDuplicates(["id", "content"])
    found = _bind(_units(text, max_chars), lambda units: _fold(units, max_lines, max_chars, overlap))
    cut = large.select("id", "first_line", found.alias("found"))
    cut = cut.select("id", "first_line", F.size("found").alias("pieces"), F.posexplode_outer("found").alias("pos", "part")).select(
        "id",
        (F.col("pos") + 1).cast("int").alias("piece"),
        F.col("pieces").cast("int").alias("pieces"),
        (F.col("first_line") + F.col("part.line")).cast("int").alias("start_line"),
        F.col("part.content").alias("content"),
    )
    whole = small.select(
        "id", F.lit(1).alias("piece"), F.lit(1).alias("pieces"), F.col("first_line").alias("start_line"), "content"
    )
    lines = F.greatest(F.coalesce(line_count(F.col("content")), F.lit(1)), F.lit(1))
    return cut.unionByName(whole).select(
        "id", "piece", "pieces", "start_line", (F.col("start_line") + lines - 1).cast("int").alias("end_line"), "content"
    )


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """Ids that the splitter had to cut: those with a second piece."""
    return pieces.where("piece = 2").select("id").distinct()
