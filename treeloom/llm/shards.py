"""Training-order materialisation of token ids.

Texts are put in order (doc_id, then a hash of the text), tokenised and cut into sequences of a
fixed length, and a sequence's number is its place in that order, however the input is laid
out. The i-th sequence goes to the slot a keyed Feistel permutation gives i; values outside the
range walk the cycle until they are inside, so slots are a permutation of 0..n-1 without any
table. Ranges of slots are written as plain files of fixed-stride records, a shard each: slot s
is record s - first of its shard, ``STRIDE`` bytes on, found by arithmetic alone.

Shards are written in passes over ranges of them, which bounds what is shuffled at a time. Each
pass commits a folder of its own; a run that broke off goes on after the last one committed.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import exists, free_shuffles, own_folder, partitions, stage

#: Tokens of a sequence, sequences of a shard, passes in which shards are written.
LENGTH, PER_SHARD, PASSES = 512, 16_384, 3
#: A record: doc_id (8 bytes), sequence within the document (4), tokens used (4), then LENGTH 16-bit ids, then a line end.
HEADER = [("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")]
#: Fills records beyond their tokens; the vocabulary leaves it free.
PAD = 65_535
ROUNDS = 6
#: Packed ids don't repeat as whole values, so no dictionary is tried.
_PLAIN = {"parquet.enable.dictionary": "false"}
#: Documents tokenised between two yields.
STEP = 500


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot in 0..n-1 of each index in 0..n-1: a balanced Feistel network with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest())) for r in range(ROUNDS)]
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    if max(ranks.values()) >= PAD:
        raise ValueError("ids must fit 16 bits and leave the last value free")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def record(length: int = LENGTH) -> np.dtype:
    return np.dtype([*HEADER, ("ids", "<u2", (length,)), ("end", "u1")])


def in_order(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``docs`` in partitions that ascend by doc_id and a hash of the text; rows that agree in both are alike."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    return keyed.repartitionByRange(partitions(docs), "doc_id", "_key", "_row").sortWithinPartitions("doc_id", "_key").select("doc_id", "text")


def sequences(docs: DataFrame, vocabulary: bytes, pattern: str, length: int = LENGTH) -> DataFrame:
    """``(part, at, doc_id, seq, n, ids)`` for each stretch of ``length`` tokens of ``docs(doc_id, text)``: its partition and its
    place there, and its ids as 16-bit binary."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size
    names = ["part", "at", "doc_id", "seq", "n", "ids"]

    def run(batches):
        from pyspark import TaskContext

        part, place, encoding = TaskContext.get().partitionId(), 0, _encoding(shipped.value, pattern)
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, len(whole), STEP)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoding.encode_to_numpy((text.as_py() or b"").decode("utf-8", "replace"), disallowed_special=()).astype("<u2")
                rows += [(doc_id, at // length, len(ids[at : at + length]), ids[at : at + length].tobytes()) for at in range(0, len(ids), length)]
            columns = [*zip(*rows, strict=True)] or [[], [], [], []]
            made = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part)), pa.array(place + np.arange(len(rows))), *made], names)
            place += len(rows)

    return in_order(docs).mapInArrow(run, "part long, at long, doc_id long, seq int, n int, ids binary")


def materialise(docs: DataFrame, vocabulary: bytes, pattern: str, path: str, key: int = 2024, length: int = LENGTH, per_shard: int = PER_SHARD, passes: int = PASSES) -> DataFrame:
    """Writes the shards of ``docs`` under ``path``, as ``pass=p/shard=s/`` with one file each, and the manifest, which it returns.

    The manifest has ``(shard, pass, first_slot, n, stride)`` of each shard; slots 0..n-1 are all
    taken. Null and empty texts have no sequence; a null doc_id is written as -1 and comes first;
    repeated rows are sequences of their own; other columns are ignored. An empty table gives an
    empty manifest. Passes already committed under ``path`` are kept, so ``path`` is for one input.
    """
    spark = docs.sparkSession
    made = stage(sequences(docs, vocabulary, pattern, length), "sequences", **_PLAIN)
    free_shuffles(spark)
    counts = stage(made.df.groupBy("part").agg(F.count("*").alias("rows")), "sequence-parts").df
    total = counts.agg(F.sum("rows")).first()[0] or 0
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select(F.col("part").alias("_part"), before.alias("first"))  # a row for each partition
    shards = -(-total // per_shard)
    each = -(-shards // passes)  # shards of a pass
    stride, body = record(length).itemsize, np.dtype([*HEADER, ("ids", "<u2", (length,))])  # the writer adds the line end
    numbered = made.df.join(firsts, F.col("part") == F.col("_part")).select((F.col("first") + F.col("at")).alias("index"), "doc_id", "seq", "n", "ids")

    def packed(number: int):
        low, high = number * each * per_shard, (number + 1) * each * per_shard

        def run(batches):
            for batch in batches:
                slots = permute(batch.column(0).to_numpy(), total, key)
                mine = np.flatnonzero((slots >= low) & (slots < high))
                batch, slots = batch.take(pa.array(mine)), slots[mine]
                out, used = np.zeros(len(mine), body), batch.column(3).to_numpy()
                out["doc_id"], out["seq"], out["n"] = batch.column(1).fill_null(-1).to_numpy(), batch.column(2).to_numpy(), used
                ids = np.full((len(mine), length), PAD, "<u2")
                if len(mine):
                    ids[np.arange(length)[None, :] < used[:, None]] = np.frombuffer(batch.column(4).buffers()[2], "<u2")[: used.sum()]
                out["ids"] = ids
                rows = pa.Array.from_buffers(pa.binary(body.itemsize), len(mine), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), rows], ["shard", "slot", "record"])

        return run

    for number in range(-(-shards // each) if shards else 0):
        target = f"{path}/pass={number}"
        if exists(spark, f"{target}/_SUCCESS"):
            continue
        rows = numbered.mapInArrow(packed(number), "shard long, slot long, record binary")
        # a partition is one shard's range of slots; known bounds need no sampling pass
        rows = rows.repartitionById(min(each, shards - number * each), (F.col("shard") - number * each).cast("int")).sortWithinPartitions("shard", "slot")
        written = rows.select("shard", F.col("record").cast("string").alias("record")).write  # bytes as they are: the cast checks nothing
        written.partitionBy("shard").mode("overwrite").option("compression", "none").option("lineSep", "\n").text(target)
        del rows, written
        free_shuffles(spark)
    made.release()
    first = F.col("id") * per_shard
    manifest = spark.range(shards).select(
        F.col("id").alias("shard"), F.expr(f"id div {max(each, 1)}").alias("pass"), first.alias("first_slot"), F.least(F.lit(per_shard).cast("long"), F.lit(total) - first).alias("n"), F.lit(stride).alias("stride")
    )
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``(slot, shard, offset, doc_id, seq, n_tokens, ids)`` of slots start..stop-1 under ``path``; other shards' files are not opened."""
    kind = record(length)
    manifest = spark.read.parquet(f"{path}/manifest").where(F.col("shard") >= start // per_shard)
    if stop is not None:
        manifest = manifest.where(F.col("first_slot") < stop)
    bounds = manifest.agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.min("pass").alias("p"), F.max("pass").alias("q")).first()
    schema = "slot long, shard long, offset long, doc_id long, seq int, n_tokens int, ids binary"
    if bounds["a"] is None:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/pass={p}" for p in range(bounds["p"], bounds["q"] + 1)]
    files = spark.read.format("binaryFile").option("basePath", path).load(folders).where(F.col("shard").between(bounds["a"], bounds["b"]))

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole, first = np.frombuffer(data.as_py(), kind), shard * per_shard
                for at in range(max(0, start - first) // STEP * STEP, len(whole), STEP):
                    slots = first + at + np.arange(len(whole[at : at + STEP]))
                    on = (slots >= start) & (slots < (stop if stop is not None else slots[-1] + 1))
                    rows, slots = whole[at : at + STEP][on], slots[on]
                    ids = pa.array([r["ids"][: r["n"]].tobytes() for r in rows], pa.binary())
                    columns = [pa.array(slots), pa.array(np.full(len(rows), shard)), pa.array((slots - first) * kind.itemsize), *(pa.array(rows[k].copy()) for k in ("doc_id", "seq", "n")), ids]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "ids"])

    return files.select(F.col("shard").cast("long"), "content").mapInArrow(run, schema)


def training_order(docs: DataFrame, vocabulary: bytes, pattern: str, key: int = 2024, **sizes) -> DataFrame:
    """Every sequence as read back from the shards, its ids as a SHA-256; see ``materialise`` for odd rows."""
    path = own_folder(docs.sparkSession, "shards")
    materialise(docs, vocabulary, pattern, path, key, **sizes)
    sizes.pop("passes", None)
    return read_slots(docs.sparkSession, path, **sizes).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
