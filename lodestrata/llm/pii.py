"""Problem 8: personal information in free text, by a character-level bidirectional LSTM with CRF transitions.

The model (pii_model, trained by pii_training from labelled spans) reads every text from start to end in overlapping
windows; equal windows of a batch are read once. Each character takes its tag from the window in whose middle it lies
most, which gives one tagging of the whole text. Combining marks are left out before the model and put back into the
spans. Spans are widened to whole tokens, and a check of the form drops what cannot be of its kind; it adds nothing.

Defined results: null, empty and blank texts hold nothing and stay as they are; the whole text is read, whatever its
length; each row gives its own result, also when texts or keys repeat; other columns are dropped.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_model import FRAME, KINDS, emissions, encode, tables, viterbi

#: Windows share so much that each character has 40 on either side in one of them, as far as the text goes; CELLS
#: characters are read at once, in at most BATCH windows. Behind each window stand END characters of class 0, as behind the
#: texts of the training, whatever windows it is read with.
WINDOW, STRIDE, BATCH, CELLS, END = 1440, 1360, 192, 300_000, 16

_up = "A-ZÀ-ÖØ-ÞŁŚŠŽ"
_low = "a-zß-öø-ÿłśšžœ"
_token = re.compile(r"[^\s,;:<>()\[\]{}\"|=]+")
_word = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\u0300-\u036f])+")
#: The word behind a first name where the model stops after it.
_second = re.compile(rf"(?:\s|[^\S\n]{{2}})({_word.pattern})(?!\w)")
_marks = re.compile(r"[\u0300-\u036f]")

_model: dict | None = None
_tables: dict | None = None


def model() -> dict:
    global _model
    if _model is None:
        data = resources.files(__package__).joinpath("pii_model.npz").read_bytes()
        with np.load(io.BytesIO(data)) as arrays:
            _model = {k: arrays[k] for k in arrays.files}
    return _model


def _known() -> dict:
    """The model's tables, computed once a worker."""
    global _tables
    if _tables is None:
        _tables = tables(model())
    return _tables


def capitalised(value: str) -> list[str]:
    """Words of any alphabet that begin with a capital letter."""
    return [w for w in _word.findall(value) if w[0].isupper()]


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Stretches of a text from start to end; the last one is as long as what is left."""
    return [(s, min(s + WINDOW, b)) for s in range(a, max(b - (WINDOW - STRIDE), a + 1), STRIDE)]


def tag_texts(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind number) of each text, as the model tags them."""
    p = model()
    jobs: dict[bytes, list[tuple[int, int, int]]] = {}
    kept: dict[int, np.ndarray] = {}  # places of the characters that are no combining marks
    for k, text in enumerate(texts):
        if not text or text.isspace():
            continue
        codes = encode(text)
        if not text.isascii() and _marks.search(text):
            kept[k] = np.array([i for i, c in enumerate(text) if not _marks.match(c)], np.int64)
            codes = codes[kept[k]]
        for s, e in windows(0, len(codes)):
            jobs.setdefault(codes[s:e].tobytes(), []).append((k, s, e))
    tagged: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    hit: set[int] = set()
    # windows of like length share a batch, the longest first
    distinct = sorted(jobs, key=len, reverse=True)
    at = 0
    while at < len(distinct):
        part = distinct[at : at + min(BATCH, max(1, CELLS // len(distinct[at])))]
        at += len(part)
        lengths = np.array([len(window) + END for window in part])
        ids = np.zeros((len(part), -(-int(lengths[0]) // FRAME) * FRAME), np.uint8)
        for row, window in enumerate(part):
            ids[row, : len(window)] = np.frombuffer(window, np.uint8)
        tags = viterbi(p, emissions(p, ids, _known(), lengths), lengths)
        for column, window in enumerate(part):
            row = tags[: len(window), column].copy()
            some = bool(row.any())
            for k, s, e in jobs[window]:
                tagged.setdefault(k, []).append((s, e, row))
                if some:
                    hit.add(k)
    out = []
    for k, text in enumerate(texts):
        spans = _reconcile(text, tagged[k]) if k in hit else []
        if k in kept:
            ends = np.append(kept[k][1:], len(text))  # marks belong to the letter before
            spans = [(int(kept[k][a]), int(ends[b - 1]), kind) for a, b, kind in spans]
        out.append(spans)
    return out


def _reconcile(text: str, parts: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """One tagging out of the windows': each character by the window in whose middle it lies most."""
    parts.sort(key=lambda x: x[0])
    spans: list[tuple[int, int, int]] = []
    group: list[tuple[int, int, np.ndarray]] = []

    def close() -> None:
        low, high = group[0][0], max(e for _, e, _ in group)
        tags = np.zeros(high - low, np.int8)
        depth = np.full(high - low, -1, np.int32)
        for s, e, row in group:
            own = np.minimum(np.arange(e - s), np.arange(e - s)[::-1])
            here = slice(s - low, e - low)
            better = own > depth[here]
            tags[here][better] = row[better]
            depth[here][better] = own[better]
        kind = np.where(tags > 0, (tags + 1) // 2, 0)
        begins = (tags > 0) & (tags % 2 == 1)
        edge = np.flatnonzero((np.diff(kind, prepend=0) != 0) | begins)
        for i, a in enumerate(edge.tolist()):
            if kind[a]:
                b = int(edge[i + 1]) if i + 1 < len(edge) else len(kind)
                spans.append((low + a, low + b, int(kind[a]) - 1))

    for part in parts:
        if group and part[0] >= max(e for _, e, _ in group):
            close()
            group = []
        group.append(part)
    if group:
        close()
    return spans


def checked(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Spans widened to whole tokens, joined where they touch, and of a possible form."""
    merged: list[list[int]] = []
    for a, b, kind in spans:
        while a > 0 and not text[a - 1].isspace() and text[a - 1] not in ",;:<>()[]{}\"'|=" and (text[a].isalnum() or text[a] in "@+"):
            a -= 1
        while b < len(text) and not text[b].isspace() and text[b] not in ",;:<>()[]{}\"'|=" and text[b - 1].isalnum():
            b += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:.!?<>\"'|"):
            b -= 1
        if KINDS[kind] == "name" and len(capitalised(text[a:b])) == 1 and (found := _second.match(text, b)) and found[1][0].isupper():
            b = found.end()
        while a < b and (text[a].isspace() or text[a] in ",;:.!?<>\"'|"):
            a += 1
        if text[a:b].startswith("(") and ")" not in text[a:b]:
            a += 1
        if merged and a < merged[-1][1] + 2 and (kind == merged[-1][2] or a < merged[-1][1]) and "\n" not in text[merged[-1][1] : a]:
            merged[-1][1] = max(merged[-1][1], b)
        elif b > a:
            merged.append([a, b, kind])
    out = []
    for a, b, number in merged:
        kind = settled(text, a, b, KINDS[number])
        if kind == "address" and number != KINDS.index("address"):
            a -= len(_house.search(text[max(0, a - 30) : a])[0])
        if possible(text, a, b, kind):
            out.append((a, b, kind))
    return out


# fixed values: words that tell what a number before or after them is, and articles that begin no name
_phone_words = re.compile(r"(?i)\b(?:tel|tél|telefon\w*|tfno|teléfono|téléphone|phone|mobile|mobil|handy|fax|call|text|llamar|joignable|reach|appeler)\b")
_id_words = re.compile(r"(?i)\b(?:ssn|social|passport|reisepass|insurance|identity|national_id|steuer|ausweis\w*|sécurité|nir|nif|nie|dni|tax|pasaporte|passeport|personal(?:ausweis)?)\b")
_articles = {"der", "die", "das", "den", "dem", "the", "le", "la", "les", "el", "los", "las", "ein", "eine", "un", "une", "una", "in", "nach", "from", "this"}
_particles = {"van", "von", "der", "den", "de", "la", "le", "las", "los", "du", "des", "da", "das", "do", "dos", "del", "della", "di", "el", "al", "bin", "ibn", "ben", "ter", "ten", "zu", "zur", "zum", "und", "y", "e", "d", "l", "af", "av"}
_house = re.compile(rf"\b\d{{1,4}}[A-Za-z]?,? (?:[{_up}][{_low}]+ ){{0,2}}$")


def settled(text: str, a: int, b: int, kind: str) -> str:
    """Phone or identity number by form and nearest word, where the model saw a number; a name behind a house number is an address."""
    value = text[a:b]
    if kind in ("phone", "id_number"):
        if re.search(r"[A-Z]", value) or re.fullmatch(r"\d{3}[ \-]\d{2}[ \-]\d{4}", value.strip("()")):
            return "id_number"
        if value[0] in "+(" or value.startswith("00") and len(value) > 11 or re.search(r"ext|/", value):
            return "phone"
        before = text[max(0, a - 40) : a].rsplit("\n", 1)[-1]
        phone = max((m.end() for m in _phone_words.finditer(before)), default=0)
        number = max((m.end() for m in _id_words.finditer(before)), default=0)
        if phone != number:
            return "phone" if phone > number else "id_number"
    if kind == "name" and _house.search(text[max(0, a - 30) : a]):
        return "address"
    return kind


def possible(text: str, a: int, b: int, kind: str) -> bool:
    value = text[a:b]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        found = re.search(r"([\w.+\-]+)\s*(?:[@＠]|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT)\s)\s*([\w\-]+(?:\s?(?:\.|[\[({<]?\s?\b(?:dot|DOT)\b\s?[\])}>]?)\s?[\w\-]+)+)", value)
        if not found or re.search(r"(?i)^(?:git|ssh|hg|svn|npm|noreply|root)$", found[1]) or text[b : b + 1] == ":" and text[b + 1 : b + 2].isalpha():
            return False
        return not re.fullmatch(r"[\d.]+", found[2])
    if kind in ("phone", "id_number") and len(set(re.findall(r"\d", value))) < 2:
        return False
    if kind == "phone" and digits < 9 and value[0] != "+" and not _phone_words.search(text[max(0, a - 40) : a].rsplit("\n", 1)[-1]):
        return False  # so short a number may be anything
    if kind == "phone":
        return 7 <= digits <= 15 and not re.sub(r"ext\.?", "", value).strip("0123456789 +()./-")
    if kind == "id_number":
        if value.isdigit() and len(value) not in (9, 10, 11, 13, 15):
            return bool(_id_words.search(text[max(0, a - 40) : a]))
        if digits < 9 and not re.search(r"[A-Z]", value) and not _id_words.search(text[max(0, a - 40) : a]):
            return False
        return (5 if re.search(r"[A-Z]", value) else 6) <= digits <= 15 and not re.search(r"[a-z]", value) and not re.search(r"[A-Z]{4,}", value)
    if kind == "address":
        return digits > 0 and bool(capitalised(value)) and len(value) > 8
    words = capitalised(value)
    if words and words[0].lower() in _articles or any(w[0].islower() and w.lower() not in _particles for w in _word.findall(value)):
        return False
    return len(words) >= 2 and digits == 0 and not re.search(r"[_(){}]", value)


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans (start, end, kind) and the text with a typed placeholder such as [EMAIL] for each of them."""
    shape = df.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                spans, masked = [], []
                for body, found in zip(texts, tag_texts([x or "" for x in texts])):
                    own = checked(body, found) if found else []
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
                    for a, b, k in reversed(own):
                        body = f"{body[:a]}[{k.upper()}]{body[b:]}"
                    masked.append(body)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(spans, kind), pa.array(masked, pa.string())], ["key", "spans", "masked"]
                )

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        find, f"key {shape}, spans array<struct<start:int,end:int,kind:string>>, masked string"
    )
    return out.select(F.col("key").alias(key), "spans", "masked")


def kinds_found(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.explode(F.array_distinct("spans.kind")).alias("kind")).distinct()
