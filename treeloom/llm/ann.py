"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector's residual from its centroid is normalised, rotated and kept as one sign bit per
dimension, with two correction scalars: the residual's norm and the inner product of the code
with the residual it stands for. A query's rotated residual is quantised to PLANES bits a
dimension; its inner product with a code is then a sum of bit counts over packed words, and
divided by the latter scalar it estimates the true one, with an error that shrinks as 1/sqrt(D).
A vector is reranked on its original components when its distance's lower bound reaches the
query's limit.

Queries travel as rows. Each goes to the centroids' cells that its limit reaches, in blocks, and
meets their vectors in bounded pieces; only its nearest of each piece go on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

#: Rows the centroids are fitted on and the queries' first limits come from; every row is indexed.
SAMPLE = 4096
CENTROIDS = 16
#: Vectors of a piece of a cell, and bytes of a block's queries, that a task holds at a time.
PIECE, BLOCK = 32_768, 64 << 20
#: Bits a dimension of a quantised query.
PLANES = 4
#: Standard deviations of the estimate's error that the bounds allow.
EPSILON = 4.0
K = 10
_ROWS, _QUERIES = 4096, 64


@dataclass(frozen=True)
class Coder:
    rotation: np.ndarray
    centroids: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, seed: int = 7) -> Coder:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        centroids = sample[rng.permutation(len(sample))[:CENTROIDS]]
        for _ in range(8):
            own = _nearest(sample, centroids)
            centroids = np.stack([sample[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centroids)])
        return cls(rotation, centroids)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, sign bits packed into 64-bit words, norm and code-residual inner product of each row."""
        own = _nearest(x, self.centroids)
        residual = x - self.centroids[own]
        norm = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(norm, norm, 1)[:, None]) @ self.rotation
        inner = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
        return own, _packed(turned > 0), norm, np.where(norm > 0, inner, 1)

    def turned(self, cell: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The queries' norms from a centroid, bit planes of their rotated residuals, and by query the least value, the step and the sum."""
        residual = queries - self.centroids[cell]
        norm = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(norm, norm, 1)[:, None]) @ self.rotation
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([_packed((level >> j) & 1) for j in range(PLANES)])
        return norm, planes, low, step, turned.sum(axis=1)

    def least(self, bits: np.ndarray, norm: np.ndarray, inner: np.ndarray, queries: tuple) -> np.ndarray:
        """Lower bounds of the squared distances, rows (of one cell) by ``turned`` queries."""
        q_norm, planes, low, step, total = queries
        dim = len(self.rotation)
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.float64)
        both = np.zeros((len(bits), len(q_norm)), np.float32)
        for j in range(PLANES):
            for w in range(bits.shape[1]):
                both += np.bitwise_count(bits[:, w, None] & planes[j][None, :, w]).astype(np.float32) * 2**j
        dot = (2 * (low[None, :] * ones[:, None] + step[None, :] * both) - total[None, :]) / np.sqrt(dim)
        coding = np.maximum(1 - inner**2, 0) / max(dim - 1, 1)  # of the code, and of the query's rounding
        rounding = 4 * step[None, :] ** 2 / 12 * ones[:, None] / dim
        upper = np.minimum(dot / inner[:, None] + EPSILON * np.sqrt(coding[:, None] + rounding) / inner[:, None], 1)
        return norm[:, None] ** 2 + q_norm[None, :] ** 2 - 2 * norm[:, None] * q_norm[None, :] * upper


def _packed(bits: np.ndarray) -> np.ndarray:
    words = -(-bits.shape[1] // 64)
    wide = np.zeros((len(bits), words * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part: of the commonest length, whole, finite, not all zero."""
    x, kind = F.col("vector"), vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are shuffled as such
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(broken, F.lit(False)) & F.exists(x, lambda v: v != 0))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["size"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _typed(rows: DataFrame) -> str:
    return f"vector {rows.schema['vector'].dataType.simpleString()}"


def build_index(rows: DataFrame, coder: Coder) -> DataFrame:
    """Codes and scalars of every row beside its vector, and a hash by which a cell's rows are dealt."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)  # D x D and CENTROIDS x D numbers

    def run(batches):
        for batch in batches:
            own, bits, norm, inner = shared.value.encode(_matrix(batch.column(1)))
            columns = [batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(inner)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "cell", "code", "norm", "inner"])

    made = rows.mapInArrow(run, f"id long, {_typed(rows)}, cell int, code binary, norm double, inner double")
    return made.withColumn("deal", F.xxhash64("id", "norm"))


def _merge(best: tuple, query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple:
    """The k best (distance, id) of each query among those held and new ones."""
    q, i, d = (np.concatenate([a, b]) for a, b in zip(best, (query, ids, dist), strict=True))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], i[keep], d[keep]


def _exact(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for at in range(0, len(r), 65_536):
        cut = slice(at, at + 65_536)
        out[cut] = np.sqrt(((rows[r[cut]] - queries[q[cut]]) ** 2).sum(axis=1))
    return out


def _limits(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of each query's k-th distance: the k-th within the sample, itself apart."""
    out = np.full(len(queries), np.inf)
    if len(sample) <= k:
        return out
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        square = (q**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1)[None, :] - 2 * q @ sample.T
        square[query_ids[at : at + 256, None] == sample_ids[None, :]] = np.inf
        out[at : at + 256] = np.partition(square, k - 1, axis=1)[:, k - 1]
    return np.sqrt(np.maximum(out, 0)) * (1 + 1e-6) + 1e-6


def route(asked: DataFrame, coder: Coder, sample: np.ndarray, sample_ids: np.ndarray, reach: np.ndarray, k: int) -> DataFrame:
    """``(id, vector, limit, cell)``: every query with its first limit, for each cell (of the given reach from its centroid) that has to be looked into."""
    shared = asked.sparkSession.sparkContext.broadcast((coder, sample, sample_ids, reach))  # SAMPLE vectors at most

    def run(batches):
        coder, sample, sample_ids, reach = shared.value
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            limits = _limits(vectors, ids, sample, sample_ids, k)
            apart = np.sqrt(np.maximum(((vectors[:, None, :] - coder.centroids[None, :, :]) ** 2).sum(axis=2), 0))
            row, cell = np.nonzero(apart - reach[None, :] <= limits[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array(limits[row]), pa.array(cell.astype(np.int32))], ["id", "vector", "limit", "cell"])

    return asked.select("id", "vector").mapInArrow(run, f"id long, {_typed(asked)}, limit double, cell int")


def search(index: DataFrame, routed: DataFrame, coder: Coder, sizes: dict[int, int], n_queries: int, k: int = K) -> DataFrame:
    """``(query_id, vec_id, score)``: at most k of each query and piece, the true nearest among them."""
    shared = index.sparkSession.sparkContext.broadcast(coder)
    blocks = max(1, -(-n_queries * 8 * len(coder.rotation) // BLOCK))
    pieces = F.element_at(F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(max(1, -(-n // PIECE))))]), F.col("cell"))
    rows = index.withColumn("piece", F.pmod("deal", pieces).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = routed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if rows.num_rows and asked.num_rows:
            best = _piece(shared.value, key[0].as_py(), rows, asked, k)
        return pa.table({"query_id": pa.array(best[0]), "vec_id": pa.array(best[1]), "score": pa.array(best[2])})

    keys = ["cell", "piece", "block"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def _piece(coder: Coder, cell: int, rows: pa.Table, asked: pa.Table, k: int) -> tuple:
    ids, vectors = rows["id"].to_numpy(), _matrix(rows["vector"].combine_chunks())
    bits = np.frombuffer(b"".join(rows["code"].to_pylist()), "<u8").reshape(len(ids), -1)
    norm, inner = rows["norm"].to_numpy(), rows["inner"].to_numpy()
    near_first = np.argsort(norm, kind="stable")  # limits fall early
    ids, vectors, bits, norm, inner = ids[near_first], vectors[near_first], bits[near_first], norm[near_first], inner[near_first]
    query_ids, queries, limit = asked["id"].to_numpy(), _matrix(asked["vector"].combine_chunks()), asked["limit"].to_numpy().copy()
    found = []
    for lo in range(0, len(queries), _QUERIES):
        part = slice(lo, lo + _QUERIES)
        own_ids, own, own_limit = query_ids[part], queries[part], limit[part]
        turned, best = coder.turned(cell, own), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for at in range(0, len(ids), _ROWS):
            cut = slice(at, at + _ROWS)
            least = coder.least(bits[cut], norm[cut], inner[cut], turned)
            r, q = np.nonzero(least <= (own_limit**2 * (1 + 1e-6) + 1e-9)[None, :])
            r = r + at
            other = ids[r] != own_ids[q]
            r, q = r[other], q[other]
            if len(r):
                dist = _exact(vectors, own, r, q)
                near = dist <= own_limit[q]
                best = _merge(best, q[near], ids[r[near]], dist[near], k)
                full, place, count = np.unique(best[0], return_index=True, return_counts=True)
                own_limit[full[count == k]] = np.minimum(own_limit[full[count == k]], best[2][(place + k - 1)[count == k]])
        found.append((own_ids[best[0]], best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank, vec_id, score.

    Queries are the usable rows for which the column ``is_query`` holds (of rows that repeat an
    id the one of least vector, component by component); candidates are all usable rows of
    another id. Rows of null id, null, zero, non-finite or odd-length vectors take no part; fewer
    than k candidates give fewer rows; equal distances go by id; rows that repeat an id are
    candidates each. At most k rows a query and piece are shuffled back.
    """
    rows = usable(vectors, id_col, vector_col)
    picked = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    if picked.empty:
        return vectors.sparkSession.createDataFrame([], empty)
    sample, sample_ids = np.stack(picked["vector"].to_numpy()).astype(np.float64), picked["id"].to_numpy()
    coder = Coder.fit(sample)
    index = stage(build_index(rows, coder), "ann-index").df
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("reach")).collect()  # CENTROIDS rows
    reach = np.full(len(coder.centroids), -np.inf)  # empty cells are out of reach
    for c in cells:
        reach[c["cell"]] = c["reach"]
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = stage(asked, "ann-queries").df
    routed = stage(route(asked, coder, sample, sample_ids, reach * (1 + 1e-9) + 1e-9, k), "ann-routed").df
    found = search(index, routed, coder, {c["cell"]: c["n"] for c in cells}, asked.count(), k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
