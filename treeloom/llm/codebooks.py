"""Vector code compression: integer product codebooks learnt by exact rounds, and their codes.

Vectors are scaled to whole numbers and cut into consecutive parts, each with a codebook of its
own. The codebooks are small and of fixed size, so they travel to the tasks; each Arrow batch
gets its squared distances by norm expansion, one 64-bit integer matrix product a part. A task
hands on the sums of each entry's parts, and a grouped shuffle merges them once a round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: Scale, parts, entries of a codebook and rounds, as the contract fixes them.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances are held at once, in numbers of entries (8 bytes each).
HELD = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """``parts[p]`` is an int64 matrix: a row for each entry of part ``p``."""

    parts: tuple[np.ndarray, ...]

    @property
    def dims(self) -> int:
        return sum(p.shape[1] for p in self.parts)

    def digest(self) -> str:
        """SHA-256 of the components' decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middles of its entries' cells."""
        at = bytes.fromhex(code)
        return [(x + 0.5) / SCALE for p, i in zip(self.parts, at, strict=True) for x in p[i].tolist()]


def largest(dims: int) -> int:
    """The largest component, by size, under which a vector's squared distances stay below 2^62."""
    return int((2**62 / max(1, dims)) ** 0.5 / 2) - 1


def cuts(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin and end; they are equal if ``parts`` divides ``dims``."""
    return [i * dims // parts for i in range(parts + 1)]


def scaled(vector: Column) -> Column:
    """``floor(SCALE * x)`` of every component; null if the vector is null or holds a null or non-finite one."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(whole, F.lit(False)), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of least squared distance for each row of ``block``, and that distance."""
    found, least = np.empty(len(block), np.int64), np.empty(len(block), np.int64)
    norms, turned, step = (codebook * codebook).sum(axis=1), np.ascontiguousarray(codebook.T), max(1, HELD // max(1, len(codebook)))
    for a in range(0, len(block), step):
        x = block[a : a + step]
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ turned) + norms
        found[a : a + step] = at = d.argmin(axis=1)
        least[a : a + step] = d[np.arange(len(x)), at]
    return found, least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, q)`` of the vectors kept."""
    return vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), scaled(F.col(vector)).alias("q")).where("q is not null")


def initial(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the ``entries`` least ids (then least components), which is all that reaches the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    if not (least := kept.orderBy(*order).select(F.size("q")).head(1)):
        return None
    dims = least[0][0]
    rows = [r.q for r in kept.where(_fitting(dims)).orderBy(*order).limit(entries).select("q").collect()]
    if not rows:
        return None
    rows, at = np.array(rows, np.int64).reshape(len(rows), dims), cuts(dims, parts)
    return Codebooks(tuple(np.ascontiguousarray(rows[:, a:b]) for a, b in zip(at, at[1:], strict=False)))


def _fitting(dims: int) -> Column:
    return (F.size("q") == dims) & F.forall("q", lambda x: x.between(-largest(dims), largest(dims)))


def improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assigns every part, then replaces each entry by the floored mean of its parts; unused entries stay."""
    at, width = cuts(books.dims, len(books.parts)), max(1, *[p.shape[1] for p in books.parts])

    def run(batches):
        sums = [np.zeros(p.shape, np.int64) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in batches:
            x = _matrix(batch.column(0), books.dims)
            for p, book in enumerate(books.parts):
                part = x[:, at[p] : at[p + 1]]
                found, _ = nearest(part, book)
                order = np.argsort(found, kind="stable")
                used, starts = np.unique(found[order], return_index=True)
                if len(used):
                    sums[p][used] += np.add.reduceat(part[order], starts, axis=0)
                counts[p] += np.bincount(found, minlength=len(book))
        rows = [(p, i, int(counts[p][i]), [*sums[p][i].tolist(), *[0] * (width - len(sums[p][i]))]) for p in range(len(sums)) for i in np.flatnonzero(counts[p]).tolist()]
        columns = [*zip(*rows, strict=True)] or [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

    told = kept.select("q").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    merged = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    new = [p.copy() for p in books.parts]
    for r in merged.collect():  # a row for each entry of a codebook at most
        new[r.part][r.entry] = [s // r.n for s in r.sums[: new[r.part].shape[1]]]
    return Codebooks(tuple(new))


def coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: entry numbers of each part in two hex digits, and the squared distances' sum.

    Vectors of another length than the codebooks', or with components so large that a squared
    distance could leave 64 bits, have a null code and error.
    """
    at = cuts(books.dims, len(books.parts))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), books.dims)
            codes, error = np.empty((len(x), len(books.parts)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books.parts):
                codes[:, p], least = nearest(x[:, at[p] : at[p + 1]], book)
                error += least
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["payload", "code", "error"])

    fits = _fitting(books.dims)
    payload = F.struct("vec_id", "label").alias("payload")
    kind = kept.select(payload).schema["payload"].dataType.simpleString()
    made = kept.where(fits).select(payload, "q").mapInArrow(run, f"payload {kind}, code string, error long").select("payload.*", "code", "error")
    return made.union(kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long")))


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``kept(vec_id, q)`` after so many rounds; None if no vector can be coded."""
    if entries > 256:
        raise ValueError("codes hold entry numbers of one byte")
    books = initial(kept, parts, entries)
    if books is None:
        return None
    fitting = kept.where(_fitting(books.dims))
    for _ in range(rounds):
        books = improved(fitting, books)
    return books


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """Codes of all usable vectors: vec_id, label, code, error, label_error and codebooks_sha256.

    Vectors that are null, or hold a null or non-finite component, are left out. The codebooks
    have the length of the vector of least id (null ids last); vectors of another length, or
    beyond ``largest``, keep their row with a null code and error and take no part. If there are
    fewer vectors than entries, so are there entries; rows that repeat count as often; ties go to
    the lower entry. ``label_error`` sums errors over equal labels (nulls are one label; null
    where all its errors are). An empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    kept = stage(_usable(vectors, id, vector, label), "vq-vectors")
    books = learn(kept.df, **how)
    columns = ["vec_id", "label", "code", "error"]
    if books is None:
        empty = kept.df.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty.select(*columns, F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    codes = stage(coded(kept.df, books), "vq-codes").df
    kept.release()
    # one row a label: summed before the shuffle; a label that many rows share is split by adaptive execution
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(*columns, "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
