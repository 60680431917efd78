"""Problem 1: groups of near-duplicate chunks, by an inverted index with count filtering.

What stands for the method's positional bytes: an entry is the 64-bit hash of a run of three words, read as a position
(its upper 56 bits) and the byte there (the lower 8) of a sparse vector. So the index is one over hashed runs; bytes at
positions of the text itself move with every insertion and guarantee no minimum. Two chunks of similarity t or more share
at least ceil(t / (1 + t) * (|A| + |B|)) entries, and, under any common order of the entries, at least s among the first
|A| - ceil(t * |A|) + s of each. So only these are listed, in the order of a frequency sketch (of fixed size), the rarest
first; the lists tally shared entries per pair, and pairs are held against the guaranteed minimum over their whole
vectors, which is the exact similarity. No link is lost: the sketch sets the order only.

Entries below FREQUENT in the sketch have short lists, which are paired out. What shares no such entry shares frequent
ones alone, so at least the guaranteed minimum of both chunks' entries must be frequent: only chunks with t of their
entries frequent stay in a long list, and only pairs with enough of them, and of like size, become candidates there.
These long lists are tallied with the smallest member of each size band first; the links found make components; only
members outside a list's leading component then meet those of other components in the neighbouring bands, in blocks.
Lists of very frequent entries are dealt over several tasks by salt.

Defined results: null contents and contents of fewer than three words have no runs and are in no group; rows of one id
are one node; a text is one node, whatever the number of its copies, named by a 64-bit hash of its words (a billion
texts have a chance of 3 % of one wrong match); other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize
from .bits import bit_map, fan_in, prune
from .graph import components

WORDS, SIMILARITY = 3, 0.6
#: Counters of the frequency sketch (2 bytes each), as a power of two: fixed, whatever the data.
SKETCH_BITS = 23
#: Listed entries that a pair must share; each one more lengthens every chunk's list by one.
SHARED = 2
#: Sketch counts from which an entry is frequent; lists of others are paired out.
FREQUENT = 24
#: Sketch counts from which a list is dealt over SALTS tasks.
VERY_FREQUENT, SALTS = 50_000, 16
#: Listed entries of a task, members of a block of a long list, and texts that a task remembers to have listed.
LIST_ROWS, BLOCK, SEEN = 2_000_000, 2_000, 300_000

_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_find = re.compile("[a-z0-9_]+").findall


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def entries_of(words: np.ndarray, run: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words."""
    if len(words) < run:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        total += words[k : len(words) - run + 1 + k] * np.uint64(_MIX[k % len(_MIX)] + 2 * (k // len(_MIX)))
    total ^= total >> np.uint64(33)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    total ^= total >> np.uint64(33)
    return np.unique(total)


def _vectors(df: DataFrame, run: int) -> DataFrame:
    """id, n (the text's node) and entries of each row that has any."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            keys, entries = [], []
            for content in batch.column(1).to_pylist():
                words = _find(content.lower()) if content else []
                if len(words) < run:
                    keys.append(None)
                    entries.append(None)
                    continue
                keys.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63))
                found = entries_of(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), run)
                entries.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(entries, pa.binary())], ["id", "n", "entries"]
            )

    rows = df.select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content"))
    found = rows.mapInArrow(vectors, "id string, n bigint, entries binary")
    return materialize(found.where("entries IS NOT NULL"), "vectors")


class _Once:
    """Nodes that a task has seen: copies of a text are counted and listed once a task, as far as memory goes."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(node)
        return True


def _frequencies(vectors: DataFrame, bits: int) -> np.ndarray:
    """The sketch: how many chunks have entries with the same leading bits. Summed in slices, in two steps of fan-in."""
    slices = 32

    def pack(counts: np.ndarray) -> bytes:
        return pa.compress(np.minimum(counts, 65535).astype("<u2").tobytes(), codec="zstd", asbytes=True)

    def unpack(data: bytes) -> np.ndarray:
        size = 2 * (1 << bits) // slices
        return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), "<u2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fresh, own = np.zeros(1 << bits, np.uint32), _Once(), 0
        for batch in batches:
            nodes, entries = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = np.frombuffer(b"".join([e for n, e in zip(nodes, entries) if fresh(n)]), "<u8")
            at, n = np.unique((found >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            total[at] += n.astype(np.uint32)
            own = nodes[0] if nodes else own
        parts = [pack(x) for x in np.split(total, slices)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(slices), pa.int32()), pa.array([own % 4096] * slices, pa.int32()), pa.array(parts, pa.binary())],
            ["at", "task", "counts"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        some = 0
        for batch in batches:
            for at, task, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[at] = np.minimum(sums.get(at, np.uint32(0)) + unpack(data).astype(np.uint32), 65535)
                some = task
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([some] * len(sums), pa.int32()), pa.array([pack(x) for x in sums.values()], pa.binary())],
            ["at", "task", "counts"],
        )

    shape = "at int, task int, counts binary"
    some, groups = fan_in(vectors.select("n", "entries"))
    merged = some.mapInArrow(count, shape)
    if groups > 1:
        merged = merged.repartition(slices * groups, "at", F.col("task") % groups).mapInArrow(merge, shape)
    merged = merged.repartition(slices, "at").mapInArrow(merge, shape)
    rows = {r["at"]: unpack(bytes(r["counts"])) for r in merged.collect()}
    return np.concatenate([rows.get(k, np.zeros((1 << bits) // slices, "<u2")) for k in range(slices)])


def listed(size: int, similarity: float) -> int:
    """How many of a chunk's entries must be listed."""
    return min(size, size - math.ceil(similarity * size - 1e-9) + SHARED)


def band(size: np.ndarray, similarity: float) -> np.ndarray:
    """Similar chunks are of one size band or of neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(similarity)).astype(np.int32)


#: Of a listed entry: salted, frequent; and that its chunk lists a frequent entry.
_SALTED, _FREQUENT, _SOME = 1, 2, 4


def _tally(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one partition.

    kind 0: pair a < b and how often short lists hold both, or SHARED if one is enough: where both list frequent entries
    too, where a long list's least member of a size band is in it, and where chunks have so few entries that they need
    only share one. kind 1: member b of long list a, with its size and its frequent entries.
    """
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        for column, k in zip(columns, range(5)):
            column.append(batch.column(k).to_numpy())
    if not columns[0]:
        return
    key, node, many, common, flags = (np.concatenate(x) for x in columns)
    order = np.lexsort((node, key))
    # a text is in a list once
    fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1])])
    order = order[fresh]
    key, node, many, common, flags = key[order], node[order], many[order], common[order], flags[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    rank = np.arange(len(key)) - np.repeat(start, size)
    length = np.repeat(size, size)
    # lists of frequent entries may still be short, unless other tasks hold more of them
    short = ((flags & _FREQUENT) == 0) | ((length <= FREQUENT) & ((flags & _SALTED) == 0))
    first, second, weight = [], [], []
    for step in range(1, int(length[short].max(initial=0))):
        at = np.flatnonzero(short & (rank + step < length))
        both = (flags[at] & flags[at + step] & _SOME) > 0
        first.append(at)
        second.append(at + step)
        weight.append(np.where(both, SHARED, 1))
    # who shares frequent entries only must have enough of them
    members = np.flatnonzero(~short & (common >= similarity * many - 1e-9))
    bands = band(many[members], similarity)
    order = np.lexsort((node[members], bands, key[members]))
    members, bands = members[order], bands[order]
    lead = np.concatenate([[True], (key[members][1:] != key[members][:-1]) | (bands[1:] != bands[:-1])]) if len(members) else np.zeros(0, bool)
    leader = members[np.maximum.accumulate(np.where(lead, np.arange(len(members)), 0))] if len(members) else members
    first.append(leader[~lead])
    second.append(members[~lead])
    weight.append(np.full(int((~lead).sum()), SHARED))
    a, b, tally = np.concatenate(first), np.concatenate(second), np.concatenate(weight)
    least, most = np.minimum(many[a], many[b]), np.maximum(many[a], many[b])
    kept = (node[a] != node[b]) & (least >= similarity * most - 1e-9)
    a, b, tally, least = node[a[kept]], node[b[kept]], tally[kept], least[kept]
    # with up to this many entries a guaranteed minimum below SHARED is possible
    tally[np.ceil(similarity * least - 1e-9) < SHARED] = SHARED
    order = np.lexsort((b, a))
    a, b, tally = a[order], b[order], tally[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
    tally = np.add.reduceat(tally, new) if len(new) else tally
    none = np.zeros(len(new), int)
    for kind, x, y, n, m in ((0, a[new], b[new], tally, none), (1, key[members], node[members], many[members], common[members])):
        for at in range(0, len(x), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(x[part]), kind, np.int32)),
                    pa.array(x[part].astype(np.int64)),
                    pa.array(y[part].astype(np.int64)),
                    pa.array(n[part].astype(np.int32)),
                    pa.array(m[part].astype(np.int32)),
                ],
                ["kind", "a", "b", "tally", "common"],
            )


def _lists(vectors: DataFrame, sketch: np.ndarray, bits: int, similarity: float) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(sketch)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, fresh = shared.value, _Once()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not fresh(n):
                    continue
                entries = np.frombuffer(data, "<u8")
                often = counts[entries >> np.uint64(64 - bits)]
                chosen = np.lexsort((entries, often))[: listed(len(entries), similarity)]
                found = often[chosen]
                flags = (found >= VERY_FREQUENT) * _SALTED + (found >= FREQUENT) * _FREQUENT + int(found[-1] >= FREQUENT) * _SOME
                common = int((often >= FREQUENT).sum())
                whole = (np.full(len(chosen), x, t) for x, t in ((n, np.int64), (len(entries), np.int32), (common, np.int32)))
                for column, value in zip(out, (entries[chosen].view(np.int64), *whole, flags.astype(np.int32))):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["key", "n", "size", "common", "flags"])

    total = vectors.agg(F.sum(F.length("entries") / 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((1 - similarity) * total / LIST_ROWS))
    lists = vectors.select("n", "entries").mapInArrow(rarest, "key bigint, n bigint, size int, common int, flags int")
    salt = F.when(F.col("flags").bitwiseAND(_SALTED) > 0, F.pmod(F.xxhash64("n"), F.lit(SALTS))).otherwise(0)
    dealt = lists.repartition(parts, F.col("key"), salt)
    return materialize(dealt.mapInArrow(partial(_tally, similarity), "kind int, a bigint, b bigint, tally int, common int"), "lists")


def _verified(pairs: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that share the guaranteed minimum of positional bytes over their whole vectors."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                kept.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    pairs = materialize(pairs.select("a", "b"), "pairs")
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    # copies of a text have equal entries: one of them stands for all
    vectors = prune(vectors.select("n", "entries"), "n", bit_map(named)).dropDuplicates(["n"])
    one = vectors.select(F.col("n").alias("a"), F.col("entries").alias("x"))
    two = vectors.select(F.col("n").alias("b"), F.col("entries").alias("y"))
    size = [F.length(c) for c in ("x", "y")]
    links = (
        pairs.select("a", "b")
        .join(one, "a")
        .join(two, "b")
        .where(F.least(*size) >= similarity * F.greatest(*size) - 1e-6)
        .select("a", "b", "x", "y")
        .mapInArrow(verify, "a bigint, b bigint")
    )
    links = materialize(links, "links")
    drop_table(pairs)
    return links


def _across(lists: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Candidates of the long lists between components: members outside a list's leading component with those of others."""
    members = lists.where("kind = 1").select(
        F.col("a").alias("key"), F.col("b").alias("n"), F.col("tally").alias("size"), "common",
        F.floor(F.log(F.greatest("tally", F.lit(1))) / -math.log(similarity)).cast("int").alias("band"),
    )
    members = members.join(groups.withColumnRenamed("node", "n"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("leading"), F.count("*").alias("kinds")).where("kinds > 1")
    members = materialize(members.join(mixed.select("key", "leading"), "key"), "members")
    blocks = members.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = members.join(blocks, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    held = held.select("key", "band", "block", F.col("n").alias("y"), F.col("size").alias("sy"), F.col("common").alias("fy"), F.col("component").alias("cy"))
    asking = members.where("component <> leading").select(
        "key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
        F.col("n").alias("x"), F.col("size").alias("sx"), F.col("common").alias("fx"), F.col("component").alias("cx"),
    )
    asking = asking.join(blocks, ["key", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    need = similarity / (1 + similarity) * (F.col("sx") + F.col("sy")) - 1e-6
    met = asking.join(held, ["key", "band", "block"]).where((F.col("cx") != F.col("cy")) & (F.least("fx", "fy", "sx", "sy") >= need))
    return members, met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_groups(
    df: DataFrame, similarity: float = SIMILARITY, run: int = WORDS, bits: int = SKETCH_BITS
) -> DataFrame:
    """id, component of each chunk that is in a group of two or more ids."""
    vectors = _vectors(df, run)
    named = vectors.select("id", "n").distinct()
    # rows of one id are one node
    least = named.groupBy("id").agg(F.min("n").alias("a"), F.count("*").alias("k")).where("k > 1")
    given = materialize(named.join(least, "id").where("n > a").select("a", F.col("n").alias("b")), "given")
    lists = _lists(vectors, _frequencies(vectors, bits), bits, similarity)
    tallied = lists.where("kind = 0").groupBy("a", "b").agg(F.sum("tally").alias("tally")).where(F.col("tally") >= SHARED)
    links = _verified(tallied, vectors, similarity)
    groups = components(links.unionByName(given))
    used = [given, lists, links]
    if not lists.where("kind = 1").isEmpty():
        members, across = _across(lists, groups, similarity)
        more = _verified(across, vectors, similarity)
        used += [members, more]
        if not more.isEmpty():
            drop_table(groups)
            groups = components(links.unionByName(given).unionByName(more))
    found = named.join(groups.withColumnRenamed("node", "n"), "n", "left").select("id", F.coalesce("component", "n").alias("component")).distinct()
    found = materialize(found, "found")
    for table in (*used, groups, vectors):
        drop_table(table)
    several = found.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    return found.join(several, "component").select("id", "component")


def pairs_of(groups: DataFrame) -> DataFrame:
    """id_a < id_b of every two ids of a group."""
    a = groups.select("component", F.col("id").alias("id_a"))
    b = groups.select("component", F.col("id").alias("id_b"))
    return a.join(b, "component").where("id_a < id_b").select("id_a", "id_b")
