"""Vectors: an offline hashed embedding, and exact cosine search in blocks of matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .lexical import top_k

DIMENSION = 768
#: Rows of a query block and of a data block: what one task holds, whatever the data.
QUERY_BLOCK, DATA_BLOCK = 512, 4096


EMBED_WORDS = 150


class _Places(dict):
    """The four places that a word's MD5 names, remembered."""

    def __missing__(self, word: str) -> np.ndarray:
        code = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest(), 16)
        if len(self) > 300_000:
            self.clear()
        self[word] = found = np.array([(code >> (8 * d)) % DIMENSION for d in range(4)])
        return found


_places = _Places()


def hashed_embeddings(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of the texts' first 150 lower-cased words: each adds 1 / (position + 1) at four places that its MD5 names."""
    words = [(t or "").lower().split()[:EMBED_WORDS] for t in texts]
    sizes = np.array([len(w) for w in words], int)
    if not sizes.sum():
        return np.zeros((len(texts), dimension), np.float32)
    places = np.concatenate([_places[w] for row in words for w in row])
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.bincount(np.repeat(row * dimension, 4) + places, np.repeat(1.0 / (at + 1), 4), len(texts) * dimension).reshape(len(texts), dimension)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return pd.Series(list(hashed_embeddings(texts.tolist())))


def cosine(a: str, b: str):
    """Cosine of two array columns, in double precision; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(c: str):
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * norm(b))


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows packed to matrices where they lie: name_ids (bytes), name_rows (bytes of float64)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                part = part.filter(pa.compute.fill_null(pa.compute.greater(pa.compute.list_value_length(part.column(1)), 0), False))
                part = part.filter(part.column(0).is_valid())
                if not part.num_rows:
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
                norm = np.sqrt((matrix**2).sum(1, keepdims=True))
                matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([matrix.tobytes()])], [f"{name}_ids", f"{name}_rows"])

    return df.select(F.col(key).cast("bigint"), F.col(vector)).mapInArrow(pack, f"{name}_ids binary, {name}_rows binary")


def _product(k: int, key: str, itself: bool):
    """Blocks of queries against blocks of rows: the k best of each pair of blocks, ties by key."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_rows, d_ids, d_rows in zip(*(batch.column(c).to_pylist() for c in range(4))):
                qi, di = np.frombuffer(q_ids, "<i8"), np.frombuffer(d_ids, "<i8")
                scores = np.frombuffer(q_rows, "<f8").reshape(len(qi), -1) @ np.frombuffer(d_rows, "<f8").reshape(len(di), -1).T
                if not itself:
                    scores[qi[:, None] == di[None]] = -np.inf
                best = min(k, len(di))
                # ties are settled by key within the block: no more than k of a query leave it
                order = np.argsort(di, kind="stable")
                di, scores = di[order], scores[:, order]
                c = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :best].ravel()
                r = np.repeat(np.arange(len(qi)), best)
                kept = np.isfinite(scores[r, c])
                r, c = r[kept], c[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[r]), pa.array(di[c]), pa.array(scores[r, c])], ["query_id", key, "score"]
                )

    return product


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """query_id, key, score, rank: the k rows nearest to each query, ties by key.

    Blocks of queries meet blocks of rows, a matrix product each, and only the k best of a block leave it. Null and empty
    vectors are left out; a vector of length 0 has score 0.
    """

    left = _blocks(queries, key, vector, QUERY_BLOCK, "q")
    right = _blocks(rows, key, vector, DATA_BLOCK, "d")
    met = left.crossJoin(right).select("q_ids", "q_rows", "d_ids", "d_rows")
    scored = met.mapInArrow(_product(k, key, itself), f"query_id bigint, {key} bigint, score double")
    return top_k(scored, k, order=key, best=F.round("score", 9))


class VectorIndex:
    """An inverted file: rows by the nearest of some centroids, which are fitted on a bounded sample of the rows.

    sample is the most rows that the fit takes (a documented bound); all rows are indexed. A search meets the probes
    nearest cells of each query only, in blocks, so a cell that holds a third of all rows is many blocks, not one task.
    cells grow with the root of the number of rows unless given.
    """

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = 20_000, seed: int = 7):
        self.rows, self.key, self.vector = rows.select(F.col(key).cast("bigint").alias(key), vector).where(F.size(vector) > 0), key, vector
        n = self.rows.count()
        # the sample is by a hash of the key, so that the fit depends on the rows and not on their order
        share = min(1.0, 1.2 * sample / max(n, 1))
        drawn = self.rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).collect()
        drawn.sort(key=lambda r: r[key])
        points = self._unit(np.array([r[vector] for r in drawn], "f8")) if drawn else np.zeros((0, 1))
        self.cells = cells or max(1, min(4096, int(n**0.5)))
        self.centroids = self._fit(points, min(self.cells, max(len(points), 1)), seed)
        self.assigned = self._assign(self.rows, 1, "cell")

    @staticmethod
    def _unit(points: np.ndarray) -> np.ndarray:
        norm = np.sqrt((points**2).sum(1, keepdims=True))
        return np.divide(points, norm, out=np.zeros_like(points), where=norm > 0)

    def _fit(self, points: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
        if not len(points):
            return np.zeros((1, points.shape[1]))
        centroids = points[np.random.default_rng(seed).permutation(len(points))[:cells]].copy()
        for _ in range(rounds):
            near = (points @ centroids.T).argmax(1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, points)
            kept = np.bincount(near, minlength=len(centroids)) > 0
            centroids[kept] = self._unit(sums[kept])
        return centroids

    def _assign(self, rows: DataFrame, probes: int, name: str) -> DataFrame:
        """key, vector and the probes nearest cells of each row; the centroids (at most 4,096) travel with the function."""
        centroids, key, vector = self.centroids, self.key, self.vector

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = VectorIndex._unit(np.array(batch.column(1).to_pylist(), "f8"))
                score = points @ centroids.T
                best = np.argsort(-score, axis=1, kind="stable")[:, : min(probes, len(centroids))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(best.astype(np.int32)))], [key, vector, name])

        kind = self.rows.schema[vector].dataType.simpleString()
        out = rows.select(key, vector).mapInArrow(nearest, f"{key} bigint, {vector} {kind}, {name} array<int>")
        return out.withColumn(name, F.explode(name))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, itself: bool = False) -> DataFrame:
        """query_id, key, score, rank of the k nearest rows among the probed cells (an eighth of them unless given)."""
        key, vector = self.key, self.vector
        probes = probes or max(1, len(self.centroids) // 8)
        asked = self._assign(queries.where(F.size(vector) > 0).select(F.col(key).cast("bigint").alias(key), vector), probes, "cell")

        def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
            """Blocks of a cell: its rows in the order of a hash, each block in a task of its own."""
            counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
            dealt = rows.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
            fields = f"cell int, {name}_ids binary, {name}_rows binary"

            def pack(table: pa.Table) -> pa.Table:
                ids = np.array(table[key].to_pylist(), "<i8")
                matrix = VectorIndex._unit(np.array(table[vector].to_pylist(), "<f8"))
                return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), f"{name}_ids": [ids.tobytes()], f"{name}_rows": [matrix.tobytes()]})

            return dealt.groupBy("cell", "block").applyInArrow(pack, fields)

        met = packed(asked, QUERY_BLOCK, "q").join(packed(self.assigned, DATA_BLOCK, "d"), "cell").select("q_ids", "q_rows", "d_ids", "d_rows")
        scored = met.mapInArrow(_product(k, key, itself), f"query_id bigint, {key} bigint, score double")
        return top_k(scored, k, order=key, best=F.round("score", 9))
