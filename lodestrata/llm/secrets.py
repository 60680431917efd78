"""Problem 5: literal credentials in chunks of code and configuration, their places and a redacted content.

Literals near an assignment context are cut into dictionary words by Viterbi; characters that no word, number or
separator explains are the residual. The dictionary is the corpus's own: words of identifiers and texts by the number of
chunks that hold them. A long residual makes a literal a secret unless it has the format of a digest, an identifier, an
address without password or an encoded image; under the name of a credential a short residual or a phrase is enough.
Placeholders, empty values, run-time values and plain names are no secrets. A value over several lines (a key block, a
concatenation) counts at the line where it starts.

Defined results: null and empty contents have no secrets and are kept as they are; repeated rows of an id with the same
content give their places once; line_no counts \\n, \\r\\n and \\r from 1; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the dictionary at most: a model parameter, taken by the number of chunks (of all chunks).
DICTIONARY_WORDS = 50_000
#: Share of all chunks that must hold a word of three letters before it explains anything; each further letter makes a
#: chance fragment rarer and takes a tenth. In small tables a share may be less than one chunk: there it is so many.
WORD_SHARE, LEAST_CHUNKS = 0.001, 5
#: Residual characters that make a literal a secret under a neutral name, and under a credential's name.
LONG_RESIDUAL, SHORT_RESIDUAL = 14, 1
MARK = "REDACTED"

# fixed values: names of credentials, as words of a key
CREDENTIALS = (
    "password passwd passwort passphrase passcode kennwort contrasena contraseña clave pwd pass secret secrets token tokens "
    "credential credentials auth authorization dsn login pem apikey bearer"
).split()
#: key after one of these is a credential
KEY_BEFORE = "api access account deploy signing private secret storage master encryption ssh shared client license salt hmac session cookie webhook signature crypto aes rsa".split()
#: endings that make a key the name of something about a credential
ABOUT = (
    "field label ref reference name names id ids type path file url uri ttl expiry expires length size count limit "
    "column param parameter from env policy regex pattern hint help placeholder error message var"
).split()
DIGEST_KEYS = "digest checksum sha sha1 sha256 sha512 md5 etag hash uuid guid commit revision fingerprint trace span build integrity".split()

_pem = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----")
_pem_end = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Of a key without an end: the lines of its armour and its text.
_pem_rest = re.compile(r"[^\r\n]*(?:[\r\n]+[ \t\"'+#/*]*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/=]+|[A-Za-z\-]+: [^\r\n]*|)[\\n\"',+; \t]*(?=[\r\n]|\Z))*")
_url = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s/:@\"'`]*:([^\s/@\"'`]+)@[\w.\-]+")
_hook = re.compile(r"https?://hooks\.[\w.\-]+/services/\w+/\w+/(\w{16,})")
_jwt = re.compile(r"eyJ[\w\-]{8,}\.eyJ?[\w\-]{8,}\.[\w\-]{8,}")
_scheme = re.compile(r"(?i)\b(?:basic|bearer|token)\s+([\w+/=.\-]{12,})")
_query = re.compile(r"(?i)[?&](?:token|key|api_?key|secret|sig|signature|password|access_token|auth)=([\w+/=.\-%]{8,})")
_aws = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
_hex = re.compile(r"(?:(?:sha\d+|md5)[:\-])?(?:[0-9a-fA-F]{7,12}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_uuid = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_integrity = re.compile(r"(?:sha(?:1|256|384|512)|md5)[\-:=][A-Za-z0-9+/=]+")
_place = re.compile(
    r"(?i)\$\{.*\}|\$\(.*\)|\$\w+|\{\{.*\}\}|<[^<>]*>|%\w+%|%[sdr]|\{\w*\}|\*+|x+|\.+|-+|_+|\?+|#+|0+|\[[^\]]*\]"
    r"|change[\-_ ]?(?:me|it|this)|(?:your|my|the|some|insert|enter|put|dummy|fake|sample|example)[\-_ ].*|todo|tbd|fixme|redacted|none|null|nil|undefined|true|false|n/?a"
    r"|placeholder|example|dummy|foo|bar|test|secret|password|token|passwd|hidden|masked|removed|not[\-_ ]set|replace[\-_ ].*"
)
_quoted = re.compile(r"\"\"\"|'''|\"((?:[^\"\\\r\n]|\\.)*)\"|'((?:[^'\\\r\n]|\\.)*)'|`((?:[^`\\\r\n]|\\.)*)`")
_key = re.compile(r"([A-Za-z_][\w.\-]*)[\"'`\])]{0,3}\s*(?::=|=>|===?|!=|=|:|,|\(|\|)?\s*\(?\s*[rbuRBU@]{0,2}$")
_option = re.compile(r"--?([A-Za-z][\w\-]*)[ =]$")
_column = re.compile(r"(?i)\(\s*([\w\", ]+)\)\s*VALUES\s*\((.*)$")
_inner = re.compile(r"\s*([A-Za-z][\w\-]*)\s*[:=]\s*(\S.*)")
_comment = re.compile(r"(?:^|\s)(?://|#|--|/\*|\*|<!--|;)\s?(.*)$")
_assign = re.compile(r"(?:^|[\s\->;{(,])((?:[A-Za-z_][\w.\-]*[ ])?[A-Za-z_][\w.\-]*)\s*(?:[:=]|\bis\b)\s*([^\s\"'`].*)$")
_open_key = re.compile(r"([A-Za-z_][\w.\-]*)[\"'\]]{0,2}\s*(?::=|=>|=|:|\()\s*(?:\(|\\|[|>][\-+]?|\[)?\s*$")
_words = re.compile(r"[A-Z]?[a-zß-ÿ]+|[A-Z]+(?![a-z])|[0-9]+")
_alpha = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_run = re.compile(r"[A-Za-z0-9+/_\-]{3,}")
_letters = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{3,}(?![A-Za-z0-9])")
#: What every line with a secret holds, if not the line before it: a credential's name, one of the forms above, or a run of
#: mixed characters as long as a residual must be. Lines without any of these pass no rule below, so nothing is lost.
_anything = re.compile(
    r"(?i:pass|pwd|secret|token|key|cred|auth|dsn|login|pem|kennwort|contrase|clave|bearer|basic|sig(?:nature)?=)|-----BEGIN|://[^\s/:@\"'`]*:[^\s/@]+@|/services/|eyJ|A[KS]IA"
    r"|(?<![\w+/=.\-])(?=[\w+/=.\-]{14})(?=[\w+/=.\-]*[0-9])(?=[\w+/=.\-]*[A-Z])[\w+/=.\-]*[a-z]"
)
#: The forms that give a secret away wherever they stand, in code, comments and commands.
_forms = (_url, _hook, _query)
UNQUOTED = {"yaml", "yml", "properties", "env", "sh", "bash", "md", "ini", "cfg", "toml", "conf", "txt", "markdown", "rst", "envrc"}


def key_words(key: str) -> list[str]:
    return [w.lower() for w in _words.findall(key)]


@lru_cache(100_000)
def key_kind(key: str) -> str:
    """credential, phrase (a credential that may be words), digest or neutral."""
    words = key_words(key)
    while words and (words[-1].isdigit() or len(words[-1]) == 1):
        words.pop()
    if not words:
        return "neutral"
    if words[-1] in ABOUT:
        return "neutral"
    if set(words) & set(DIGEST_KEYS):
        last = max((k for k, w in enumerate(words) if w in CREDENTIALS), default=-1)
        if last < max(k for k, w in enumerate(words) if w in DIGEST_KEYS):
            return "digest"
    joined = " ".join(words)
    if "passphrase" in words or "pass phrase" in joined or "mot de passe" in joined:
        return "phrase"
    if any(w in CREDENTIALS for w in words):
        return "credential"
    if any(a in KEY_BEFORE and b in ("key", "keys") for a, b in zip(words, words[1:])):
        return "credential"
    return "neutral"


class Segmenter:
    """Viterbi over a dictionary: each word costs its negative log frequency, each unexplained character a constant."""

    UNKNOWN, NUMBER = 9.0, 3.0

    def __init__(self, counts: dict[str, int]):
        total = max(sum(counts.values()), 1)
        self.cost = {w: math.log(total / n) / 2 + 1 for w, n in counts.items() if len(w) > 2}
        self.longest = max(map(len, self.cost), default=1)
        self.residual = lru_cache(200_000)(self._residual)

    def _residual(self, text: str) -> int:
        """Letters and digits of the best segmentation that no word and no plain number explains."""
        total = 0
        for run in re.findall(r"[A-Za-z0-9]+", text):
            n, low = len(run), run.lower()
            best = [0.0] + [math.inf] * n
            left = [0] * (n + 1)
            for i in range(n):
                here = best[i]
                cost = here + self.UNKNOWN
                if cost < best[i + 1]:
                    best[i + 1], left[i + 1] = cost, left[i] + 1
                if run[i].isdigit() and (i == 0 or not run[i - 1].isdigit()):
                    j = i
                    while j < n and run[j].isdigit():
                        j += 1
                    # a number explains itself at the end of a run, or alone
                    if j == n and here + self.NUMBER < best[j]:
                        best[j], left[j] = here + self.NUMBER, left[i]
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    word = self.cost.get(low[i:j])
                    if word is not None and _cased(run[i:j]) and here + word < best[j]:
                        best[j], left[j] = here + word, left[i]
            total += left[n]
        return total


def _cased(word: str) -> bool:
    """Written as words are: all small, all capital or with a capital first letter."""
    return word.islower() or word.isupper() or word[1:].islower()


def is_secret(value: str, kind: str, segmenter: Segmenter) -> bool:
    """Whether the literal value under a key of the given kind is a credential."""
    text = value.strip()
    if not text or _place.fullmatch(text):
        return False
    for form in (_url, _hook, _query):
        found = form.search(text)
        if found and not _place.fullmatch(found[1]):
            return True
    if _jwt.search(text) or _aws.search(text) or _pem.search(text):
        return True
    found = _scheme.match(text)
    if found:
        return not _place.fullmatch(found[1]) and segmenter.residual(found[1]) > 3
    if kind == "digest" or text.startswith(("data:", "-----BEGIN", "ssh-", "ecdsa-")) or _uuid.fullmatch(text) or _integrity.fullmatch(text):
        return False
    if re.match(r"[a-z]+://|\.{0,2}/", text):
        return False
    plain = bool(re.fullmatch(r"[\w+/=.\-]+", text))
    residual = segmenter.residual(text)
    if kind in ("credential", "phrase"):
        if re.search(r"\$\{|\{\{|\$\(|\w\(.*\)$|process\.env|os\.environ|getenv", text):
            return False
        if " " in text:
            return kind == "phrase" and len(text.split()) > 2
        if len(text) < 6:
            return False
        letters = [w for w in re.findall(r"[A-Za-z]+", text)]
        number = bool(re.search(r"\d", text))
        odd = bool(re.search(r"[^\w.\-/: ]", text))
        if residual > 2 or (residual >= SHORT_RESIDUAL and (number or odd)):
            return True
        # words with a number or a sign among them are a password, words alone a name
        return bool(letters) and (odd or (number and "-" in text))
    if _hex.fullmatch(text) or not plain:
        return False
    # an identifier of mixed case and digits with a long unexplained part
    rest = re.sub(r"^(?:[a-z]{2,5}[_\-])+", "", text)
    mixed = bool(re.search(r"[0-9]", rest) and re.search(r"[a-z]", rest) and re.search(r"[A-Z]", rest))
    return mixed and residual >= LONG_RESIDUAL and not re.fullmatch(r"[A-Za-z0-9+/]{60,}={0,2}", text)


def find(content: str, path: str | None, segmenter: Segmenter) -> list[tuple[int, int, int]]:
    """(line_no, start, end) of each credential's value, in characters of the content."""
    if not content or not _anything.search(content):
        return []
    tail = (path or "").rsplit("/", 1)[-1].lower()
    ending = tail.rsplit(".", 1)[-1] if "." in tail else tail
    unquoted = ending in UNQUOTED or tail.startswith((".env", "dockerfile"))
    lines = re.split(r"(\r\n|\n|\r)", content)
    found: list[tuple[int, int, int]] = []
    at = 0
    closed = 0  # lines before this belong to a value already found
    before = ""
    joined = False  # the line before ended in a concatenation
    for number in range(1, len(lines) // 2 + 2):
        line = lines[2 * number - 2]
        start = at
        at += len(line) + (len(lines[2 * number - 1]) if 2 * number - 1 < len(lines) else 0)
        if start < closed:
            before, joined = line, bool(re.search(r"[+\\.]\s*$", line))
            continue
        spans: list[tuple[int, int]] = []
        key_block = _pem.search(line)
        if key_block:
            stop = _pem_end.search(content, start + key_block.end())
            stop = stop.end() if stop else _pem_rest.match(content, start + key_block.end()).end()
            found.append((number, start + key_block.start(), stop))
            closed = stop
            before, joined = line, False
            continue
        if _anything.search(line) or line.lstrip(" \t([+")[:1] in ('"', "'", "`") and (opened := _open_key.search(before)) and key_kind(opened[1]) in ("credential", "phrase"):
            carried = (joined and re.match(r"\s*[+.]?\s*[\"'`]", line)) or (
                re.match(r"\s*[+.]\s*[\"'`]", line) and re.search(r"[^\"'`\s][\"'`]\s*$", before)
            )
            if not carried:
                spans = _line_spans(line, before, lines, number, unquoted, segmenter)
        for a, b in spans:
            found.append((number, start + a, start + b))
        if spans and re.search(r"[\"'`]\s*(?:\+\s*\\?|\\|\.)\s*$", line):
            joined = True
        else:
            joined = bool(joined and re.search(r"[\"'`]\s*(?:\+\s*\\?|\\|\.)\s*$", line))
        before = line if line.strip() else before
    return found


def _line_spans(line: str, before: str, lines: list[str], number: int, unquoted: bool, segmenter: Segmenter) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    literals = [m for m in _quoted.finditer(line) if m.lastindex]
    comment = _comment.search(line)
    for m in literals:
        a, b = m.span(m.lastindex)
        value = m[m.lastindex]
        prefix = line[: m.start()]
        key = ""
        if found := _option.search(prefix):
            key = found[1]
        elif found := _column.search(prefix):
            names = [x.strip(' "') for x in found[1].split(",")]
            place = found[2].count(",")
            key = names[place] if place < len(names) else ""
        elif re.search(r"(?i)\b(?:identified\s+by|password)\s+$", prefix):
            key = "password"
        elif found := _key.search(prefix):
            key = found[1]
        elif not prefix.strip(" \t([+"):
            found = _open_key.search(before)
            key = found[1] if found else ""
        if re.search(r"[\"'`]\s*(?:\+\s*\\?|\\|\.)\s*$", line[m.start() :]) and m is literals[-1]:
            # a concatenation: the next line's literal belongs to the value
            following = lines[2 * number] if 2 * number < len(lines) else ""
            more = _quoted.search(following)
            value += more[more.lastindex] if more and more.lastindex else ""
        kind = key_kind(key)
        if value and is_secret(value, kind, segmenter):
            spans.append((a, b))
            continue
        inner = _inner.fullmatch(m[m.lastindex])
        if inner and is_secret(inner[2], key_kind(inner[1]), segmenter):
            spans.append((a + inner.start(2), b))
    if spans:
        return spans
    if spans := _bare_forms(line, segmenter):
        return spans
    text, offset = line, 0
    if comment:
        text, offset = comment[1], comment.start(1)
    elif not unquoted:
        return spans
    found = _assign.search(text)
    while found:
        key, value = found[1], found[2].rstrip()
        kind = key_kind(key)
        if kind == "neutral" and " " in key:
            kind = key_kind(key.split()[-1])
        value_end = value
        if kind != "phrase":
            value_end = value.split()[0] if not _scheme.match(value) else " ".join(value.split()[:2])
            if comment or "://" in value_end:
                value_end = value_end.rstrip(",;")
        if value_end and not re.match(r"[\"'`{\[(]", value_end) and is_secret(value_end, kind, segmenter):
            a = offset + found.start(2)
            return [(a, a + len(value_end))]
        # a label such as "old:" before the assignment itself
        text, offset = text[found.start(2) :], offset + found.start(2)
        found = _assign.search(text)
    return spans


def _bare_forms(line: str, segmenter: Segmenter) -> list[tuple[int, int]]:
    """Addresses with a password, web hooks, signed queries and tokens that stand in a line without quotes or a key."""
    for form, mark in zip(_forms, ("://", "/services/", "=")):
        for m in form.finditer(line) if mark in line else ():
            value = m[1].strip("'\"")
            if not _place.fullmatch(value) and "$" not in value and "{" not in value and (form is not _query or segmenter.residual(value) > 3):
                return [m.span(1)]
    found = "eyJ" in line and _jwt.search(line) or "IA" in line and _aws.search(line)
    return [found.span()] if found else []


def evidence(run: str) -> list[str]:
    """Words that a run of text vouches for: none beside digits, none out of a literal of mixed case and digits."""
    if len(run) >= 12 and re.search(r"[0-9]", run) and re.search(r"[a-z]", run) and re.search(r"[A-Z]", run):
        return []
    return [w.lower() for token in _letters.findall(run) for w in _alpha.findall(token) if len(w) > 2]


#: A quoted literal of one word, and what is assigned under any name: values, among which secrets stand.
_literal = re.compile(r"\"[^\"\s\\]{6,}\"|'[^'\s\\]{6,}'|`[^`\s\\]{6,}`")
# fixed values: what names of credentials hold
_NAMES = "pass pwd secret token key cred auth dsn login pem kennwort contrase clave bearer basic".split()
_credential_name = re.compile(rf"(?i)(?:{'|'.join(_NAMES)})[\w\-]*[\"']?\s*(?:[:=(,]|\bis\b|\s)\s*[^\r\n]*")


def vouching(content: str) -> str:
    """A content without what may be a secret itself: literals of one word, and what follows a credential's name in a line.

    So a secret does not become a word of the dictionary, however many chunks hold it.
    """
    low = content.lower()
    if any(name in low for name in _NAMES):
        content = _credential_name.sub(" ", content)
    return _literal.sub(" ", content)


def dictionary(df: DataFrame, words: int = DICTIONARY_WORDS, least: int = LEAST_CHUNKS, share: float = WORD_SHARE) -> dict[str, int]:
    """Words of all contents by the number of chunks that hold them, the most frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        split: dict[str, list[str]] = {}
        seen: set[int] = set()
        for batch in batches:
            for content in batch.column(0).to_pylist():
                # a content counts once a task, however often it is copied
                name = hash(content)
                if not content or name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                own = set()
                for run in set(_run.findall(vouching(content))):
                    parts = split.get(run)
                    if parts is None:
                        if len(split) > 300_000:
                            split.clear()
                        parts = split[run] = evidence(run)
                    own.update(parts)
                total.update(own)
                if len(total) > 1_000_000:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(list(total.values()), pa.int64())})
                    total = Counter()
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}
        )

    counted = df.select(F.col("content").cast("string")).mapInArrow(count, "word string, n bigint")
    support = F.lit(share * df.count()) * F.pow(F.lit(10.0), 3 - F.length("word"))
    rows = (
        counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") >= support))
        .orderBy(F.desc("n"), "word").limit(words).collect()
    )
    return {r["word"]: r["n"] for r in rows}


def find_secrets(df: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """id, places (line_no, start, end) and redacted content of each row of df (id, file_path, content)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(df) if counts is None else counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            places, redacted = [], []
            for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = find(content, path, segmenter) if content else []
                places.append([{"line_no": n, "start": a, "end": b} for n, a, b in found])
                for _, a, b in reversed(found):
                    content = content[:a] + MARK + content[b:]
                redacted.append(content)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places, kind), pa.array(redacted, pa.string())], ["id", "places", "redacted"]
            )

    return df.select(
        F.col("id").cast("string").alias("id"),
        F.col("file_path").cast("string").alias("file_path"),
        F.col("content").cast("string").alias("content"),
    ).mapInArrow(search, "id string, places array<struct<line_no:int,start:int,end:int>>, redacted string")


def secret_lines(found: DataFrame) -> DataFrame:
    return found.select("id", F.explode("places").alias("place")).select("id", "place.line_no").distinct()
