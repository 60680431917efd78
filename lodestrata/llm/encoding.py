"""Problem 6: encoding of whole texts with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's split pattern; each distinct piece is merged once per worker by a segment tree over
the ranks of its adjacent pairs. A leaf holds rank * 2^bits + position, so the root is the leftmost pair of the lowest
rank; a merge changes three leaves, each in logarithmic time, and the piece is done when no pair at the root has a rank.

Defined results: null and empty texts give an empty list; repeated rows are encoded each; the texts' length has no limit.
Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter everywhere.
VOCABULARIES = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker's memo of pieces is emptied at this many entries; it changes no result.
MEMO_ENTRIES = 400_000
#: Unicode's White_Space, as the split pattern means it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(major: str, last: int) -> str:
    """A character class of the code points up to last of a major category."""
    out, start = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code))[0] == major
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append((start, code - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def split_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """The public split pattern of byte_bpe_50k for texts of code points up to last; small classes match faster."""
    letter, number = _ranges("L", last), _ranges("N", last)
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


class Encoder:
    """Byte-level BPE over a rank file; memoises pieces."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.narrow = split_pattern(0x7F).findall
        self.plane = split_pattern(0xFFFF).findall
        self.wide = split_pattern().findall
        encoder = self

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(encoder.merge(piece.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes()
                if len(piece) <= 64:
                    if len(self) >= memo_entries:
                        self.clear()
                    self[piece] = ids
                return ids

        class Sizes(dict):
            def __missing__(self, piece: str) -> int:
                size = len(encoder.memo[piece]) // 4
                if len(piece) <= 64:
                    if len(self) >= memo_entries:
                        self.clear()
                    self[piece] = size
                return size

        self.memo = Memo()
        self.sizes = Sizes()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the segment tree."""
        ranks = self.ranks
        n = len(piece)
        if n == 1:
            return [ranks[piece]]
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        bits = n.bit_length()
        low = (1 << bits) - 1
        none = 1 << 62
        get = ranks.get
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 2))
        before = list(range(-1, n + 1))
        while tree[1] != none:
            i = tree[1] & low
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            p = before[i]
            for at, stop in ((j, -1), (i, after[k] if k < n else -1), (p, k)):
                if at < 0:
                    continue
                rank = get(piece[at:stop]) if stop > 0 else None
                leaf = none if rank is None else rank << bits | at
                at += width
                if at >= 2 * width or tree[at] == leaf:
                    continue
                tree[at] = leaf
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
                    at >>= 1
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.narrow(text)
        return self.plane(text) if max(text) <= "\uffff" else self.wide(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return sum(map(self.sizes.__getitem__, self.split(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per row of df: its key and the ids of its text."""
    path = vocabulary_path(folder)
    kind = df.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                coded = [own.encode(x) if x else b"" for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in coded], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        encode, f"key {kind.simpleString()}, ids array<int>"
    )
    return out.select(F.col("key").alias(key), "ids")


def with_token_counts(df: DataFrame, key: str, text: str, folder: str | None = None) -> DataFrame:
    """key, text and n_tokens of each row; null and empty texts count 0."""
    path = vocabulary_path(folder)
    kind = df.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = [own.count(x) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["key", "text", "n_tokens"]
            )

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        count, f"key {kind.simpleString()}, text string, n_tokens bigint"
    )
