"""Problem 7: filling containers of fixed capacity with whole documents, related ones together.

Documents are dealt to shards by topic: the rarest of a document's terms that enough documents share, by a sketch of term
frequencies of fixed size. Shards are ranges of (topic, a hash of the key), cut to an even number of documents, so a topic
that a third of all documents share is many shards, and small ones lie together. A shard builds a BM25 inverted index of
its documents, with the whole corpus' statistics; the largest unused document is the seed of a container, the index
returns its unused neighbours by score, and these fill the container greedily; what gap is left takes the largest unused
documents that fit. Containers that end up below close_at are dissolved and their items dealt again, to fewer shards, so
that the loss at the ends of shards does not add up; the last round closes what it fills.

Sizes are tokens of byte_bpe_50k. A document larger than the capacity becomes full containers and one rest, which is an
item like any other. Defined results: null and empty texts have size 0 and lie in some container; a repeated key is two
items, with the same key; columns other than the key and the text are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bits import fan_in
from .encoding import encoder, vocabulary_path

CAPACITY = 4096
#: Documents of a shard in each round; a later round only gets what the one before left open.
SHARD_DOCS = 2000
#: Counters of the sketch of term frequencies, as a power of two (4 MB), and the share of a shard that a topic must fill.
TERM_BITS, TOPIC_SHARE = 20, 16
ROUNDS = 3
CLOSE_AT = 0.995
K1, B = 1.5, 0.75

_SHAPE = "key bigint, part int, size int, terms binary, counts binary"
_PLACED = "key bigint, part int, size int, container string, closed boolean, terms binary, counts binary"


def _items(df: DataFrame, key: str, text: str, capacity: int, folder: str | None) -> DataFrame:
    """key, part, size and the hashed terms of each item; oversized documents as full parts (no terms) and a rest."""
    path = vocabulary_path(folder)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        word = re.compile(r" ?\w+").fullmatch

        class Hashes(dict):
            def __missing__(self, piece: str) -> int:
                value = zlib.crc32(piece.strip().lower().encode("utf-8", "surrogatepass")) if word(piece) else -1
                if len(self) > 400_000:
                    self.clear()
                self[piece] = value
                return value

        hashes = Hashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = Counter(own.split(body)) if body else {}
                size = sum(map(int.__mul__, map(own.sizes.__getitem__, pieces), pieces.values()))
                terms = np.fromiter(map(hashes.__getitem__, pieces), np.int64, len(pieces))
                counts = np.fromiter(pieces.values(), np.int64, len(pieces))
                counts, terms = counts[terms >= 0], terms[terms >= 0]
                full, rest = divmod(size, capacity)
                for part in range(full):
                    for column, value in zip(out, (name, part, capacity, None, None)):
                        column.append(value)
                if rest or not full:
                    found = (terms.astype("<u4").tobytes(), np.minimum(counts, 65535).astype("<u2").tobytes())
                    for column, value in zip(out, (name, full, rest, *found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                ["key", "part", "size", "terms", "counts"],
            )

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        items, _SHAPE
    )


def _term_counts(items: DataFrame, bits: int = TERM_BITS) -> np.ndarray:
    """How many items hold a term of the same leading bits; summed on the executors in two steps."""

    def pack(counts: np.ndarray) -> pa.RecordBatch:
        data = pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<u4")
            total += np.bincount(flat >> np.uint32(32 - bits), minlength=1 << bits)
        yield pack(np.minimum(total, 0xFFFFFFFF))

    def unpack(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, decompressed_size=4 << bits, codec="zstd", asbytes=True), "<u4").astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unpack(data)
        yield pack(np.minimum(total, 0xFFFFFFFF))

    some, groups = fan_in(items.select("terms"))
    parts = some.mapInArrow(count, "counts binary").repartition(8 * groups).mapInArrow(merge, "counts binary")
    merged = parts.repartition(1).mapInArrow(merge, "counts binary").first()
    return unpack(bytes(merged[0])) if merged else np.zeros(1 << bits, np.int64)


class ShardIndex:
    """BM25 postings of one shard. df holds the frequencies of the corpus per hashed term, n_all and mean its size and mean
    length; without them the shard's own are taken."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], df: np.ndarray | None = None, n_all: int = 0, mean: float = 0.0):
        n = len(terms)
        sizes = np.array([len(t) for t in terms])
        docs = np.repeat(np.arange(n), sizes)
        flat = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        tf = (np.concatenate(counts) if n else np.zeros(0)).astype(np.float64)
        length = np.bincount(docs, tf, n) if n else np.zeros(0)
        mean = mean or max(length.mean() if n else 0.0, 1.0)
        names, of = np.unique(flat, return_inverse=True)
        own = np.bincount(of, minlength=len(names))
        held = own if df is None else np.maximum(df[names >> np.uint32(32 - TERM_BITS)], own)
        idf = np.log(np.maximum(max(n_all, n) - held + 0.5, 0.5) / (held + 0.5) + 1)
        order = np.argsort(of, kind="stable")
        weight = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[docs] / mean))
        self.docs, self.weight = docs[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(own)])
        self.query = np.split(of, np.cumsum(sizes)[:-1]) if n else []
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the terms of one."""
        out = np.zeros(self.n)
        start, docs, weight = self.start, self.docs, self.weight
        for term in self.query[doc].tolist():
            a, b = start[term], start[term + 1]
            if b - a > 1:
                out[docs[a:b]] += weight[a:b]
        return out


def fill(sizes: np.ndarray, index: ShardIndex, capacity: int) -> list[list[int]]:
    """Containers of item numbers: seeds from the largest down, their neighbours by score, then the best fits."""
    by_size = np.argsort(-sizes, kind="stable")
    free = sizes > 0
    containers: list[list[int]] = []
    for seed in by_size.tolist():
        if not free[seed]:
            continue
        free[seed] = False
        inside, gap = [seed], capacity - int(sizes[seed])
        open_items = np.flatnonzero(free & (sizes <= gap))
        if len(open_items):
            score = index.scores(seed)[open_items]
            ranked = open_items[np.lexsort((open_items, -score))]
            near = int((score > 0).sum())
            ranked = ranked[:near]
            while len(ranked):
                ranked = ranked[sizes[ranked] <= gap]
                if not len(ranked):
                    break
                # a neighbour that leaves no gap ends the search; else the most related one that fits
                exact = ranked[sizes[ranked] == gap]
                item = int(exact[0]) if len(exact) else int(ranked[0])
                if not len(exact) and gap - sizes[item] < sizes[ranked].min():
                    item = int(ranked[np.argmax(sizes[ranked])])
                inside.append(item)
                free[item] = False
                gap -= int(sizes[item])
                ranked = ranked[ranked != item]
            while gap:
                fits = open_items[free[open_items] & (sizes[open_items] <= gap)]
                if not len(fits):
                    break
                item = int(fits[np.argmax(sizes[fits])])
                inside.append(item)
                free[item] = False
                gap -= int(sizes[item])
        containers.append(inside)
    empty = np.flatnonzero(sizes == 0).tolist()
    if empty:
        if containers:
            containers[-1].extend(empty)
        else:
            containers.append(empty)
    return containers


def topic_of(terms: np.ndarray, df: np.ndarray, least: int) -> int:
    """The rarest term that at least so many items hold, else the most frequent one; -1 for an item without terms."""
    if not len(terms):
        return -1
    held = df[terms >> np.uint32(32 - TERM_BITS)]
    enough = held >= least
    if not enough.any():
        return int(terms[held == held.max()].min())
    return int(terms[enough & (held == held[enough].min())].min())


def _dealt(items: DataFrame, shards: int, counts, least: int, turn: int) -> DataFrame:
    """items in shards: ranges of topics, a topic's items in the order of a hash."""

    def topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = counts.value
        for batch in batches:
            found = [topic_of(np.frombuffer(x or b"", "<u4"), df, least) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "topic"])

    named = items.select("key", "part", "size", "terms", "counts").mapInArrow(topics, f"{_SHAPE}, topic bigint")
    return named.repartitionByRange(shards, "topic", F.xxhash64("key", "part", F.lit(turn)))


def _fill_shards(items: DataFrame, shards: int, turn: int, capacity: int, close_at: float, counts, least: int, n_all: int, mean: float) -> DataFrame:
    last = close_at <= 0

    def fill_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks().sort_by([("key", "ascending"), ("part", "ascending")])
        sizes = table["size"].to_numpy().astype(np.int64)
        terms = [np.frombuffer(x or b"", "<u4") for x in table["terms"].to_pylist()]
        tf = [np.frombuffer(x or b"", "<u2") for x in table["counts"].to_pylist()]
        shard = TaskContext.get().partitionId()
        name = np.empty(len(sizes), object)
        closed = np.zeros(len(sizes), bool)
        for k, inside in enumerate(fill(sizes, ShardIndex(terms, tf, counts.value, n_all, mean), capacity)):
            done = last or sizes[inside].sum() >= close_at * capacity
            for item in inside:
                name[item] = f"{turn}-{shard}-{k}"
                closed[item] = done
        blank = pa.nulls(len(sizes), pa.binary())
        keep = pa.array(closed)
        done = pa.table(
            {
                "key": table["key"],
                "part": table["part"],
                "size": table["size"],
                "container": pa.array(name, pa.string()),
                "closed": keep,
                # terms only travel on with what stays open
                "terms": pa.compute.if_else(keep, blank, table["terms"]),
                "counts": pa.compute.if_else(keep, blank, table["counts"]),
            }
        )
        yield from done.to_batches()

    return _dealt(items, shards, counts, least, turn).mapInArrow(fill_shard, _PLACED)


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    shard_docs: int = SHARD_DOCS,
    folder: str | None = None,
) -> DataFrame:
    """key, part (from 0), container, size of each item."""
    import pyarrow.compute  # noqa: F401  (the shards use it)

    items = materialize(_items(df, key, text, capacity, folder), "items")
    full = items.where(F.col("size") == capacity).select(
        "key", "part", "size", F.concat_ws("-", F.lit("full"), "key", "part").alias("container")
    )
    rest = items.where(F.col("size") < capacity)
    done = [full]
    counts = df.sparkSession.sparkContext.broadcast(_term_counts(rest))  # 8 MB, whatever the data
    n_all, words = rest.agg(F.count("*"), F.avg(F.length("counts") / 2)).first()
    for turn in range(1, ROUNDS + 1):
        left = rest.count()
        if not left:
            break
        shards = max(1, -(-left // shard_docs))
        final = turn == ROUNDS or (shards == 1 and turn > 1)
        least = max(2, min(shard_docs, left // 4) // TOPIC_SHARE)
        filled = _fill_shards(rest, shards, turn, capacity, 0.0 if final else CLOSE_AT, counts, least, n_all, float(words or 1.0))
        placed = materialize(filled, "placed")
        done.append(placed.where("closed").select("key", "part", "size", "container"))
        rest = placed.where("not closed").select("key", "part", "size", "terms", "counts")
        if final:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(key), "part", "container", "size")
