"""Column functions on texts: tokens, lines, identifiers, query correction. All run in the JVM but for the fuzzy match."""

from __future__ import annotations

from difflib import get_close_matches

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import ABBREVIATIONS, SPELLING

#: Every line end that Python's splitlines knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end; none for an empty text."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def bm25_tokens(text: Column) -> Column:
    """ASCII words of the lexical index: camel case cut, lower case."""
    return all_matches(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[a-zA-Z0-9]+")


def camel_split(text: Column) -> Column:
    cut = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(cut, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def snake_split(text: Column) -> Column:
    return F.translate(text, "_", " ")


def simple_tokens(text: Column) -> Column:
    """Distinct tokens for reranking: whole words in lower case, and their camel parts where there are several."""

    def parts(word: Column) -> Column:
        pieces = F.split(F.lower(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")), " ")
        return F.concat(F.array(F.lower(word)), F.when(F.size(pieces) > 1, pieces).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(all_matches(text, "[a-zA-Z0-9_]+"), parts)))


def query_tokens(text: Column) -> Column:
    """Distinct words of three characters or more that mark lines as relevant."""
    return F.array_distinct(all_matches(F.lower(text), "[a-zA-Z0-9_]{3,}"))


def rough_tokens(text: Column) -> Column:
    """A third of the characters, and one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def normalise_symbols(text: Column) -> Column:
    """Code punctuation spaced out, in a fixed order of rules; generics of up to 30 characters go with their content."""
    for pattern, by in (
        (r"[@#](?U:(\w))", "$1"),
        (r"\s*->\s*|\s*=>\s*|\s*::\s*", " "),
        (r"(?<!\d)\.(?!\d)", " "),
        (r"<[^>]{0,30}>", " "),
        (r"[(){}\[\]]", " "),
        (r"[;:,!?]", " "),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


# fixed values: forms of names in a question, in this order
SYMBOL_FORMS = [
    r"(?U)\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b",
    r"(?U)\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b",
    r"(?U)\b\w+_\w+\b",
    r"(?U)\b\w+(?=\(\))",
]


def code_symbols(text: Column) -> Column:
    """Camel, Pascal, snake and call names in that order, each once, longer than three characters."""
    return F.filter(F.array_distinct(F.concat(*[all_matches(text, form) for form in SYMBOL_FORMS])), lambda x: F.length(x) > 3)


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _capital_kept(word: Column, fixed: Column) -> Column:
    upper = F.concat(F.upper(F.substring(fixed, 1, 1)), F.substr(fixed, F.lit(2)))
    return F.when(F.substring(word, 1, 1).rlike("[A-Z]"), upper).otherwise(fixed)


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _changed(word: Column, fixed: Column, note: str = "") -> Column:
    """The new word, and what is said of the change; null where nothing changes."""
    log = F.when(F.lower(fixed) != F.lower(word), F.concat(F.lit("'"), word, F.lit("' → '"), fixed, F.lit("'" + note)))
    return F.struct(fixed.alias("word"), log.alias("log"))


def _joined(changed: Column) -> tuple[Column, Column]:
    return F.array_join(F.transform(changed, lambda x: x["word"]), " "), F.array_compact(F.transform(changed, lambda x: x["log"]))


def _spelled(text: Column, fuzzy: Column | None = None) -> Column:
    known = _lookup(SPELLING)

    def fix(word: Column) -> Column:
        stays = (F.length(word) <= 2) | word.rlike("^[^a-z]*[A-Z][^a-z]*$") | word.rlike(r"^\d+$")
        fixed = F.try_element_at(known, F.lower(word))
        out = F.when(~stays & fixed.isNotNull(), _changed(word, _capital_kept(word, fixed)))
        if fuzzy is not None:
            near = F.try_element_at(fuzzy, word)
            out = out.when(~stays & (F.length(word) >= 7) & near.isNotNull() & (F.lower(near) != F.lower(word)), _changed(word, near, " (codebase symbol)"))
        return out.otherwise(_changed(word, word))

    return F.transform(_words(text), fix)


def fix_spelling(text: Column) -> Column:
    """Known misspellings word by word; short, all-capital and numeric words stay."""
    return _joined(_spelled(text))[0]


def _expanded(text: Column) -> Column:
    known = _lookup(ABBREVIATIONS)

    def expand(word: Column) -> Column:
        fixed = F.try_element_at(known, F.lower(F.regexp_replace(word, r"\p{Punct}+$", "")))
        return F.when(fixed.isNull(), _changed(word, word)).otherwise(_changed(word, _capital_kept(word, fixed)))

    return F.transform(_words(text), expand)


def expand_abbreviations(text: Column) -> Column:
    """Known abbreviations word by word; any punctuation behind one goes with it."""
    return _joined(_expanded(text))[0]


def correct_query(
    text: Column, fuzzy: Column | None = None, spelling: bool = True, abbreviations: bool = True, identifiers: bool = True
) -> Column:
    """struct(original, corrected, symbols, changes, was_corrected) of a question: symbols, splitting, spelling, abbreviations.

    fuzzy is a column that maps words to the nearest name of the code base (see nearest_names); each step can be left out. Null and blank
    questions stay as they are.
    """
    plain = normalise_symbols(F.trim(text))
    cut = plain
    if identifiers:
        camel = F.transform(_words(plain), lambda w: F.when(w.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]"), camel_split(w)).otherwise(w))
        cut = snake_split(F.array_join(camel, " "))
    split = F.when(cut != plain, F.array(F.lit("identifier split"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    done, spell_log = _joined(_spelled(cut, fuzzy)) if spelling else (cut, none)
    done, short_log = _joined(_expanded(done)) if abbreviations else (done, none)
    done = F.trim(F.regexp_replace(done, r"\s+", " "))
    first_upper = text.rlike(r"^\p{Lu}") & done.rlike(r"^\p{Ll}")
    done = F.when(first_upper, F.concat(F.upper(F.substring(done, 1, 1)), F.substr(done, F.lit(2)))).otherwise(done)
    changes = F.concat(split, spell_log, short_log)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.struct(
        text.alias("original"),
        F.when(blank, text).otherwise(done).alias("corrected"),
        F.when(blank, none).otherwise(code_symbols(F.trim(text))).alias("symbols"),
        F.when(blank, none).otherwise(changes).alias("changes"),
        F.when(blank, False).otherwise(F.size(changes) > 0).alias("was_corrected"),
    )


def fuzzy_match(vocabulary: list[str], cutoff: float = 0.85):
    """A vectorised function from words to their closest vocabulary entry as written there (difflib ratio of the lower-cased
    forms), else the word itself; words under seven characters stay.

    The vocabulary is the bounded symbol list (500 names), so it travels with the function.
    """
    written: dict[str, str] = {}
    for name in vocabulary:
        written.setdefault(name.lower(), name)
    lowered = [name.lower() for name in vocabulary]

    @F.pandas_udf(StringType())
    def match(words: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def best(word: str | None) -> str | None:
            if word is None or len(word) < 7:
                return word
            if word not in memo:
                found = get_close_matches(word.lower(), lowered, n=1, cutoff=cutoff)
                memo[word] = written[found[0]] if found else word
            return memo[word]

        return words.map(best)

    return match


def nearest_names(vocabulary: list[str]):
    """A vectorised function from a text to a map of its long words to the nearest names of the vocabulary."""
    match = fuzzy_match(vocabulary).func

    @F.pandas_udf("map<string,string>")
    def nearest(texts: pd.Series) -> pd.Series:
        words = [[w for w in (t or "").split() if len(w) >= 7] for t in texts]
        flat = pd.Series(sorted({w for row in words for w in row}), dtype=object)
        found = dict(zip(flat, match(flat)))
        return pd.Series([{w: found[w] for w in row if found[w] != w} for row in words])

    return nearest


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute, minutes below an hour, else hours and minutes."""
    whole = F.floor(seconds).cast("int")
    return (
        F.when(seconds < 60, F.format_string("%ds", whole))
        .when(seconds < 3600, F.format_string("%dm %02ds", F.floor(whole / 60).cast("int"), whole % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int")))
    )


def fallback_terms(text: Column) -> Column:
    return F.slice(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 4), 1, 3)
