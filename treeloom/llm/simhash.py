"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``radius`` or fewer differing bits. The bits are grouped into m partitions,
correlated ones together; any thresholds t_i >= -1 that add up to reach - m + 1 leave, for each
pair within ``reach`` bits, a partition i in which the two differ in t_i bits at most. Each
fingerprint picks its own thresholds by dynamic programming over estimated candidate counts,
probes the index of each partition within t_i bits, and every candidate is verified on all bits.

Two settings: 64 bits at a small radius, where reach = radius and no link is lost; and wide
fingerprints, which find candidates for a Jaccard similarity (``similar``): as many partitions as
leave a pair of that similarity a chance of MISS to differ in all of them, whatever the number of
texts. There the radius only sifts; what links is settled on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Staged, free_shuffles, stage, staging
from .components import connected_components

SHINGLE, RADIUS, WORD, SEED = 4, 4, 64, 42
#: Bits of a sub-partition, whose value counts are kept in full for the estimates.
SUB = 8
#: What a candidate costs, in probes.
CANDIDATE_COST = 0.05
#: Index entries under one key, or so many times what chance fills it with, beyond which it is worked by one of them and
#: in blocks of BLOCK, STEP of their rows at a time.
HEAVY, TIMES, BLOCK, STEP = 20, 4, 2048, 128
#: Words hashed at a time, which bounds memory for texts of any length.
CHUNK = 50_000
#: The chance that a pair of the similarity asked for differs in every partition of a wide fingerprint.
MISS = 0.01
#: Texts that chance puts under a key of a wide fingerprint's partition, from this to twice as many.
CROWD = 32
#: Partitions of one block of bits whose correlations are measured.
PER_BLOCK = 4
#: Bits of a wide fingerprint at least: what the partitions leave over sharpens the estimate.
LEAST_BITS = 2048
#: Standard errors of the estimate by which the radius of a similarity is widened.
SLACK = 3.0
#: Bits of the filter by which the texts whose shingles are wanted are found in one pass over all.
WANTED = 1 << 26
#: Standard errors by which two fingerprints' first words may differ more than the radius has it.
SKETCH_SLACK = 3.0
#: Partial sums of a wide plan's thresholds stay within so many of nought.
ROOM = 6
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Kind:
    """What is fingerprinted and when two fingerprints link."""

    shingle: int = SHINGLE
    bits: int = WORD
    radius: int = RADIUS
    #: Whether shingles count once each, however often they occur.
    distinct: bool = False
    #: Bits of a partition and how many there are; 0: as is cheapest for an exact join.
    width: int = 0
    parts: int = 0
    #: The Jaccard similarity that links; 0: the radius does.
    similarity: float = 0.0

    def sketch_radius(self) -> int:
        if self.bits == WORD:
            return self.radius
        p = differing(self.similarity) if self.similarity else self.radius / self.bits
        return int(WORD * p + SKETCH_SLACK * sqrt(WORD * p * (1 - p)))

    def missed(self, similarity: float) -> float:
        """The chance that a pair of a Jaccard similarity differs in every partition (thresholds of nought)."""
        return (1 - (1 - differing(similarity)) ** self.width) ** self.parts


def differing(similarity: float) -> float:
    """The share of SimHash bits in which two sets of equal size and this Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def similar(n: int, similarity: float = 0.8, shingle: int = 5) -> Kind:
    """Wide fingerprints for n texts that link at a Jaccard similarity of distinct shingles.

    A partition's keys hold CROWD texts or more by chance, which are cheap to sift, so that partitions are narrow and agree often;
    there are as many as MISS asks for. The radius is SLACK standard errors beyond what the similarity makes differ.
    """
    width, p = max(8, (max(n, 1) // CROWD).bit_length() - 1), differing(similarity)
    parts = ceil(log(MISS) / log(1 - (1 - p) ** width))
    parts += -parts % PER_BLOCK
    bits = max(width * parts, LEAST_BITS)
    bits += -bits % WORD
    return Kind(shingle, bits, int(bits * p + SLACK * sqrt(bits * p * (1 - p))), True, width, parts, similarity)


def fingerprint(text: bytes, kind: Kind = Kind()) -> bytes:
    """The SimHash of a text, little-endian: bit b is set if over half of its shingles' hashes have it; no words: 0.

    The first 64 bits of a shingle's hash are its XXH64; each further 64 are those mixed anew.
    """
    words, size = text.lower().split(), kind.shingle  # bytes: A-Z only, and exactly the six ASCII white space characters
    parts = [_shingles(words[at : at + CHUNK + size - 1], size) for at in range(0, max(len(words) - size + 1, 1), CHUNK)] if words else []
    if kind.distinct and parts:
        parts = [np.unique(np.concatenate(parts))]
    ones, total = np.zeros(kind.bits, np.int64), 0
    for hashes in parts:
        total += len(hashes)
        for at in range(0, len(hashes), 255):  # as many as a byte counts
            wide = np.unpackbits(_widened(hashes[at : at + 255], kind.bits // WORD).view(np.uint8), axis=1, bitorder="little")
            ones += np.add.reduce(wide, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > total, bitorder="little").tobytes()


def shingles(text: bytes, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; none without words."""
    words = text.lower().split()
    parts = [_shingles(words[at : at + CHUNK + size - 1], size) for at in range(0, max(len(words) - size + 1, 1), CHUNK)] if words else []
    return np.unique(np.concatenate(parts)) if parts else np.array([], np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have that Jaccard similarity; without shingles both or neither."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    spans = map(slice, (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _widened(hashes: np.ndarray, words: int) -> np.ndarray:
    if words == 1:
        return hashes[:, None]
    more = _mixed(hashes[:, None] + _ODD[0] * np.arange(1, words, dtype=np.uint64)[None, :])
    return np.concatenate([hashes[:, None], more], axis=1)


def fingerprints(docs: DataFrame, kind: Kind = Kind()) -> DataFrame:
    """``(doc_id, row, node, fp)`` for each row of ``docs(doc_id, text)``; null texts have no words.

    ``row`` is a hash of the text; ``node`` names the fingerprint: itself if it has 64 bits, else a hash of it.
    """

    def run(batches):
        for batch in batches:
            made = [fingerprint(x.as_py() or b"", kind) for x in batch.column(2)]
            nodes = [int.from_bytes(x, "little") if kind.bits == WORD else xxhash.xxh3_64_intdigest(x, SEED) for x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(made, pa.binary())], ["doc_id", "row", "node", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, row long, node long, fp binary")


@dataclass(frozen=True)
class Plan:
    """The bits of each partition, and for each the distance counts of its sub-partitions' values."""

    kind: Kind
    parts: tuple[tuple[int, ...], ...]
    counts: tuple[tuple[np.ndarray, ...], ...]
    n: int
    reach: int
    most: int

    def values(self, bits: np.ndarray) -> np.ndarray:
        """The value of each partition, (n, m), from rows of single bits."""
        layout = np.full((len(self.parts), WORD), bits.shape[1])
        for i, part in enumerate(self.parts):
            layout[i, : len(part)] = part
        padded = np.concatenate([bits, np.zeros((len(bits), 1), np.uint8)], axis=1)[:, layout.ravel()]
        return np.ascontiguousarray(np.packbits(padded, axis=1, bitorder="little")).view("<u8").reshape(len(bits), -1)

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, an (n, m) array, by dynamic programming over partitions."""
        n, m = values.shape
        goal = self.reach - m + 1
        room = m if self.kind.width == 0 else min(ROOM, m)
        low, states = -room, np.full((n, max(goal, 0) + 2 * room + 1), np.inf)
        states[:, room] = 0
        choices = []
        for i, (bits, tables) in enumerate(zip(self.parts, self.counts, strict=True)):
            expected = np.zeros((n, self.most + 1))
            expected[:, 0] = 1
            for j, table in enumerate(tables):
                near = table[(values[:, i] >> np.uint64(j * SUB)).astype(np.int64) & (1 << min(SUB, len(bits) - j * SUB)) - 1]
                expected = np.stack([sum(expected[:, d - e] * near[:, e] for e in range(d + 1)) for d in range(self.most + 1)], axis=1)
            cost = np.concatenate([np.zeros((n, 1)), self.n * CANDIDATE_COST * np.cumsum(expected, axis=1)], axis=1)
            cost[:, 1:] += np.cumsum([comb(len(bits), d) for d in range(self.most + 1)])
            best, pick = np.full_like(states, np.inf), np.zeros(states.shape, np.int8)
            for t in range(-1, self.most + 1):
                moved = np.full_like(states, np.inf)
                to, of = (slice(t, None), slice(None, -t)) if t > 0 else (slice(None), slice(None)) if t == 0 else (slice(None, -1), slice(1, None))
                moved[:, to] = states[:, of] + cost[:, t + 1, None]
                pick = np.where(moved < best, np.int8(t), pick)
                best = np.minimum(best, moved)
            states = best
            choices.append(pick)
        out, at = np.empty((n, m), np.int8), np.full(n, goal - low)
        for i in reversed(range(m)):
            out[:, i] = choices[i][np.arange(n), at]
            at = at - out[:, i]
        return out


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits: each starts at the free bit of the highest total correlation and takes its closest."""
    share, bits = np.diag(together) / max(n, 1), len(together)
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    correlation = np.abs(np.divide(together / max(n, 1) - np.outer(share, share), spread, out=np.zeros_like(spread), where=spread > 0))
    np.fill_diagonal(correlation, 0)
    free, parts = set(range(bits)), []
    for size in (bits // m + (i < bits % m) for i in range(m)):
        rest = sorted(free)
        part = [max(rest, key=lambda b: (correlation[b, rest].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(sorted(free), key=lambda b: (correlation[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def best_partition_count(n: int, radius: int) -> int:
    """How many partitions make uniform fingerprints of 64 bits cheapest to join."""

    def cost(m: int) -> float:
        width, left = WORD // m, radius - m + 1
        t = [left // m + (i < left % m) for i in range(m)]
        probes = [sum(comb(width, d) for d in range(x + 1)) for x in t]
        return sum(p + CANDIDATE_COST * p * n / 2**width for p in probes)

    return min(range(1, radius + 2), key=cost)


def _bits(column: pa.Array, at: int, step: int) -> np.ndarray:
    rows = column.slice(at, step)
    return np.unpackbits(np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")


def fit_plan(classes: DataFrame, n: int, kind: Kind = Kind()) -> Plan:
    """Partitions and estimates from all of ``classes(fp)``; what reaches the driver is of fixed size for each block of bits."""
    size = kind.width * PER_BLOCK or kind.bits
    blocks = [(lo, min(lo + size, kind.width * kind.parts or kind.bits)) for lo in range(0, kind.width * kind.parts or kind.bits, size)]

    def pairs(batches):
        total = [np.zeros((hi - lo, hi - lo), np.int64) for lo, hi in blocks]
        for batch in batches:
            for at in range(0, len(batch), 4_000):
                x = _bits(batch.column(0), at, 4_000).astype(np.float32)
                for t, (lo, hi) in zip(total, blocks, strict=True):
                    t += (x[:, lo:hi].T @ x[:, lo:hi]).astype(np.int64)
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    cells = classes.select("fp").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    together = np.zeros(sum((hi - lo) ** 2 for lo, hi in blocks))
    together[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    parts, at = [], 0
    for lo, hi in blocks:
        m = PER_BLOCK if kind.width else best_partition_count(n, kind.radius)
        found = group_bits(together[at : at + (hi - lo) ** 2].reshape(hi - lo, hi - lo), n, m)
        parts += [tuple(lo + b for b in part) for part in found]
        at += (hi - lo) ** 2
    reach, most = (len(parts) - 1, 1) if kind.width else (kind.radius, kind.radius)
    subs = [(i, part[j : j + SUB]) for i, part in enumerate(parts) for j in range(0, len(part), SUB)]
    layout = np.full((len(subs), SUB), kind.bits)
    for k, (_, bits) in enumerate(subs):
        layout[k, : len(bits)] = bits

    def seen(batches):
        total = np.zeros((len(subs), 2**SUB), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                x = _bits(batch.column(0), at, 2_000)
                values = np.packbits(np.concatenate([x, np.zeros((len(x), 1), np.uint8)], axis=1)[:, layout.ravel()], axis=1, bitorder="little")
                for k in range(len(subs)):
                    total[k] += np.bincount(values[:, k], minlength=2**SUB)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "n"])

    cells = classes.select("fp").mapInArrow(seen, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(subs) * 2**SUB)
    count[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    apart = np.bitwise_count(np.arange(2**SUB)[:, None] ^ np.arange(2**SUB)[None, :])
    tables: list[list[np.ndarray]] = [[] for _ in parts]
    for (i, _), row in zip(subs, count.reshape(-1, 2**SUB), strict=True):
        tables[i].append(np.stack([((apart == d) * row).sum(axis=1) / max(n, 1) for d in range(SUB + 1)], axis=1))
    return Plan(kind, tuple(parts), tuple(map(tuple, tables)), n, reach, most)


_POSTING = "key long, node long, sketch long, held boolean, asks boolean"


def _keys(values: np.ndarray, part: int) -> np.ndarray:
    return _mixed(values ^ np.uint64((part + 1) * int(_ODD[0]) & 2**64 - 1)).view(np.int64)


def _postings(classes: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """``(key, node, sketch, held, asks)``: each fingerprint's own key in every partition, which holds it, and when probing
    whether it asks there too, and every other key within its thresholds, where it only asks."""
    flips = [[np.array([sum(1 << b for b in bits) for d in range(1, t + 1) for bits in combinations(range(len(part)), d)], np.uint64) for t in range(plan.most + 1)] for part in plan.parts] if probing else []

    def run(batches):
        def made(keys, nodes, sketch, held, asks):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, nodes, sketch, np.full(len(keys), held), asks)], ["key", "node", "sketch", "held", "asks"])

        for batch in batches:
            for at in range(0, len(batch), 1_000):
                bits, nodes = _bits(batch.column(1), at, 1_000), batch.column(0).slice(at, 1_000).to_numpy()
                sketch = np.packbits(bits[:, :WORD], axis=1, bitorder="little").view("<i8").ravel()
                values = plan.values(bits)
                chosen = plan.thresholds(values) if probing else np.full(values.shape, -1)
                for i in range(len(plan.parts)):
                    yield made(_keys(values[:, i], i), nodes, sketch, True, chosen[:, i] >= 0)
                    for t in range(1, plan.most + 1) if probing else ():
                        on = np.flatnonzero(chosen[:, i] == t)
                        if on.size:
                            keys = _keys(values[on, i][:, None] ^ flips[i][t][None, :], i)
                            yield made(keys.ravel(), np.repeat(nodes[on], keys.shape[1]), np.repeat(sketch[on], keys.shape[1]), False, np.ones(keys.size, bool))

    return classes.select("node", "fp").mapInArrow(run, _POSTING)


def _sifted(postings: DataFrame, radius: int) -> DataFrame:
    """``(key, node, other, asks)``: who is near by the sketch under a key.

    Pairs (node, other), or where a key has more of them than rows, as among near copies, its rows that are near
    any (other is null): so what comes out is never more than what goes in.
    """

    def near(nodes, sketch, held, asks):
        left, right, sketch = np.flatnonzero(asks), np.flatnonzero(held), sketch.view(np.uint64)  # of signed numbers the absolute value would be counted
        close = np.bitwise_count(sketch[left][:, None] ^ sketch[right][None, :]) <= radius
        close &= nodes[left][:, None] < nodes[right][None, :]
        i, j = np.nonzero(close)
        if len(i) <= len(nodes):
            return nodes[left[i]], nodes[right[j]], np.ones(len(i), bool)
        one, two = nodes[left[close.any(axis=1)]], nodes[right[close.any(axis=0)]]
        return np.concatenate([one, two]), None, np.repeat([True, False], [len(one), len(two)])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            columns = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            cut = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            yield from done(columns, cut)
            rest = [x[cut[-1] if len(cut) else 0 :] for x in columns]
        if rest is not None:
            yield from done(rest, np.array([len(rest[0])]))

    def done(columns, cut):
        """What is near under the keys that end at ``cut``."""
        out = []
        for lo, hi in zip([0, *cut], cut):
            if hi - lo > 1:
                nodes, others, asks = near(*(x[lo:hi] for x in columns[1:]))
                if len(nodes):
                    out.append((np.full(len(nodes), columns[0][lo]), nodes, pa.nulls(len(nodes), pa.int64()) if others is None else pa.array(others), asks))
        if out:
            key, node, other, asks = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(node)), pa.concat_arrays(other), pa.array(np.concatenate(asks))], ["key", "node", "other", "asks"])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, other long, asks boolean")


def linked_pairs(classes: DataFrame, plan: Plan, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(src, dst)`` of nodes of ``classes(node, fp)``, enough of them to connect all that link.

    ``sets_of`` gives ``(node, shingles)`` of a table of nodes where a similarity links. Under
    ordinary keys every candidate is verified: pair by pair, or where a similarity links and a key
    has more of them than entries, all of the key's at once. Under a key of over HEAVY entries all
    are first held against one of them, and what links to it needs no look at one another; those
    that don't are compared with all in bounded blocks.
    """
    kind = plan.kind
    probes, entries = _postings(classes, plan, True), _postings(classes, plan, False)
    usual = plan.n / 2 ** min(map(len, plan.parts))
    heavy = stage(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(HEAVY, int(TIMES * usual))), "simhash-heavy").df
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= kind.sketch_radius()
    some = not heavy.isEmpty()
    light = lambda postings: postings.join(heavy.select("key"), "key", "left_anti") if some else postings
    dense = None
    if kind.similarity:
        sifted = stage(_sifted(light(probes), kind.sketch_radius()), "simhash-near").df
        found = sifted.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst"))
        dense = sifted.where("other is null").select("key", F.lit(0).alias("team"), F.lit(0).alias("block"), "node", "asks")
    else:
        on = (F.col("p.key") == F.col("e.key")) & (F.col("p.node") < F.col("e.node")) & near(F.col("p.sketch"), F.col("e.sketch"))
        found = light(probes.where("asks")).alias("p").join(light(entries).alias("e"), on).select(F.col("p.node").alias("src"), F.col("e.node").alias("dst"))
    if not some:
        edges = _verified(found.distinct(), classes, kind, sets_of)
        return edges if dense is None else edges.union(_cell_links(dense, classes, kind, sets_of))
    # whose own keys they are, and who probes them besides
    met = stage(probes.join(heavy, "key").select("key", "n", "node", "sketch", "held"), "simhash-met").df
    first = met.where("held").groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node", "sketch")).alias("first"))
    first = stage(first.select("key", F.col("first.node").alias("first"), F.col("first.sketch").alias("first_sketch")), "simhash-first").df
    met = met.join(first, "key").select("key", "n", "node", "first", near(F.col("sketch"), F.col("first_sketch")).alias("near"))
    stars = met.where("near and node <> first").select(F.least("node", "first").alias("src"), F.greatest("node", "first").alias("dst"))
    edges = stage(_verified(found.union(stars).distinct(), classes, kind, sets_of), "simhash-links").df
    free_shuffles(classes.sparkSession)
    tied = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    met = met.join(tied, (F.least("node", "first") == F.col("_a")) & (F.greatest("node", "first") == F.col("_b")), "left")
    met = stage(met.select("key", "n", "node", (F.col("_a").isNull() & (F.col("node") != F.col("first"))).alias("free")), "simhash-split").df
    cells = _cells(met)
    return edges.union(_cell_links(cells if dense is None else cells.union(dense), classes, kind, sets_of))


def _verified(pairs: DataFrame, classes: DataFrame, kind: Kind, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The pairs that differ in ``radius`` bits at most (64 bits were compared in the join) and are as alike as is asked for."""
    if kind.bits == WORD:
        return pairs

    def near(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(len(batch), -1) for k in (2, 3))
            keep = pa.array(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= kind.radius)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    def both(rows: DataFrame, facts: DataFrame) -> DataFrame:
        a, b = (facts.toDF(k, f"{k}_fact") for k in ("src", "dst"))
        return rows.join(a, "src").join(b, "dst").select("src", "dst", "src_fact", "dst_fact")

    sifted = both(pairs, classes.select("node", "fp")).mapInArrow(near, "src long, dst long")
    if not kind.similarity:
        return sifted

    def linked(batches):
        for batch in batches:
            sets = [[np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (2, 3)]
            keep = pa.array([alike(a, b, kind.similarity) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    sifted = stage(sifted, "simhash-sifted").df
    sets = stage(sets_of(sifted.select(F.col("src").alias("node")).union(sifted.select("dst")).distinct()), "simhash-sets").df
    return both(sifted, sets).mapInArrow(linked, "src long, dst long")


def _near(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[slice, np.ndarray]]:
    """For STEP of the ``left`` rows at a time, which of the ``right`` differ from them in ``radius`` bits at most."""
    for cut in (slice(at, at + STEP) for at in range(0, len(left), STEP)):
        apart = np.zeros((len(left[cut]), len(right)), np.int16)
        for k in range(fps.shape[1]):
            apart += np.bitwise_count(fps[left[cut], k][:, None] ^ fps[right, k][None, :])
        yield cut, apart <= radius


def _cells(met: DataFrame) -> DataFrame:
    """``(key, team, block, node, asks)``: where the free rows of ``met(key, n, node, free)`` meet all others of their key, which has n entries.

    Both the free rows of a key and all its rows are dealt into blocks of about BLOCK, and each
    two blocks meet in a cell: a free row goes to all blocks of rows, any row to all blocks of
    free ones. Keys without free rows need none.
    """
    wanted = stage(met.where("free").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("teams")), "simhash-wanted").df
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = met.join(wanted, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    asked = dealt.where("free").select("key", own(F.col("teams")).alias("team"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(True).alias("asks"))
    held = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team"), own(F.col("blocks")).alias("block"), "node", F.lit(False).alias("asks"))
    return asked.union(held)


def _cell_links(cells: DataFrame, classes: DataFrame, kind: Kind, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links of the rows of ``cells(key, team, block, node, asks)`` that ask to the others of their cell, which a task makes a spanning forest of."""
    cells = cells.join(classes.select("node", "fp"), "node")

    def sides(cell):
        nodes, asks = cell["node"].to_numpy(), cell["asks"].to_numpy(zero_copy_only=False)
        return nodes, np.frombuffer(b"".join(cell["fp"].to_pylist()), "<u8").reshape(len(nodes), -1), np.flatnonzero(asks), np.flatnonzero(~asks)

    def forest(cell):
        nodes, fps, left, right = sides(cell)
        low, far = nodes.copy(), np.iinfo(np.int64).max
        pairs = [*_near(fps, left, right, kind.radius)]
        while True:
            new = low.copy()
            for cut, close in pairs:
                new[left[cut]] = np.minimum(new[left[cut]], np.where(close, new[right][None, :], far).min(axis=1, initial=far))
                new[right] = np.minimum(new[right], np.where(close, new[left[cut]][:, None], far).min(axis=0, initial=far))
            if (new == low).all():
                break
            low = new
        return pa.table({"src": nodes[nodes != low], "dst": low[nodes != low]})

    if not kind.similarity:
        return cells.groupBy("key", "team", "block").applyInArrow(forest, "src long, dst long")

    def involved(cell):
        """The rows of a cell that are near one of the other side."""
        nodes, fps, left, right = sides(cell)
        keep = np.zeros(len(nodes), bool)
        for cut, close in _near(fps, left, right, kind.radius):
            close &= nodes[left[cut]][:, None] != nodes[right][None, :]
            keep[left[cut]] |= close.any(axis=1)
            keep[right] |= close.any(axis=0)
        return cell.filter(pa.array(keep)).select(["key", "team", "block", "node", "asks", "fp"])

    def alike_forest(cell):
        """A spanning forest of what is alike: rows that are connected already need no look."""
        nodes, fps, left, right = sides(cell)
        sets, out = [np.frombuffer(x, "<u8") for x in cell["shingles"].to_pylist()], []
        names, root = np.unique(nodes, return_inverse=True)
        group = np.arange(len(names))
        for cut, close in _near(fps, left, right, kind.radius):
            for i, near in zip(left[cut].tolist(), close, strict=True):
                rest = right[near]
                while (rest := rest[group[root[rest]] != group[root[i]]]).size:
                    j, rest = int(rest[0]), rest[1:]
                    if alike(sets[i], sets[j], kind.similarity):
                        out.append((int(nodes[i]), int(nodes[j])))
                        group[group == group[root[j]]] = group[root[i]]
        src, dst = zip(*out, strict=True) if out else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    kinds = "key long, team int, block int, node long, asks boolean, fp binary"
    close = stage(cells.groupBy("key", "team", "block").applyInArrow(involved, kinds), "simhash-close").df
    sets = stage(sets_of(close.select("node").distinct()), "simhash-close-sets").df
    links = close.join(sets, "node").groupBy("key", "team", "block").applyInArrow(alike_forest, "src long, dst long")
    return links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def shingle_sets(docs: DataFrame, reps: DataFrame, kind: Kind) -> DataFrame:
    """``(node, shingles)`` of ``reps(node, doc_id, row)``: the sorted hashes of each one's text.

    The texts are found in one pass over ``docs`` by a filter of WANTED bits, which is all that
    reaches the driver and the tasks, so only texts that are wanted (and few others) are shuffled.
    """
    place = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(WANTED)).cast("int")
    marked = np.zeros(WANTED, bool)
    for batch in reps.select(place("doc_id", "row").alias("at")).distinct().toArrow().to_batches():
        marked[batch.column(0).to_numpy()] = True
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches):
        bits = shipped.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            some = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)) & 1)
            for k in range(0, len(some), 256):
                part = batch.take(pa.array(some[k : k + 256]))
                sets = [shingles(x.as_py() or b"", kind.shingle).astype("<u8").tobytes() for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sets, pa.binary())], ["doc_id", "row", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    made = texts.select(place("doc_id", "row").alias("at"), "doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, shingles binary")
    return made.join(reps, ["doc_id", "row"]).select("node", "shingles").dropDuplicates(["node"])


def _judged(docs: DataFrame, kind: Kind) -> tuple[Staged, Staged]:
    """The fingerprinted rows, and ``(node, rep, component)`` of each class: its least doc_id and its component's name."""
    with staging() as held:
        fingerprinted = stage(fingerprints(docs, kind), "fingerprints")
        least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
        classes = fingerprinted.df.groupBy("node").agg(least.alias("least"), F.first("fp").alias("fp"))
        classes = stage(classes.select("node", F.col("least.doc_id").alias("rep"), F.col("least.row").alias("rep_row"), "fp"), "simhash-classes").df
        named = classes.where("rep is not null")
        plan = fit_plan(named, named.count(), kind)
        reps = named.select("node", F.col("rep").alias("doc_id"), F.col("rep_row").alias("row"))
        edges = stage(linked_pairs(named, plan, lambda nodes: shingle_sets(docs, reps.join(nodes, "node", "left_semi"), kind)).distinct(), "simhash-edges").df
        free_shuffles(docs.sparkSession)
        merged = connected_components(edges).withColumnRenamed("node", "member")
        of_class = classes.select("node", "rep").join(merged, classes.node == merged.member, "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
        done = stage(of_class, "simhash-merged")
    for x in held:
        if x is not fingerprinted and x is not done:
            x.release()
    return fingerprinted, done


def near_duplicates(docs: DataFrame, kind: Kind = Kind()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Texts of one fingerprint form a class (counted before any shuffle of members), and classes
    are linked, never their members; component_id is the least doc_id among a component's
    classes. Null texts and texts without words have fingerprint zero and are linked like any
    other. Rows without a doc_id take their class's component and name none themselves (null if
    no member has an id). Repeated rows give repeated rows; rows of one doc_id with different
    texts are classes of their own.
    """
    made, of_class = (x.df for x in _judged(docs, kind))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "component").select("node", "component_id")
    shown = F.hex("node") if kind.bits == WORD else F.hex("fp")
    return made.join(of_class, "node").select("doc_id", F.lower(F.lpad(shown, kind.bits // 4, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, kind: Kind | None = None) -> DataFrame:
    """One row of ``docs``, that of the least doc_id, for each group of texts whose distinct five-word
    shingles have a Jaccard similarity of 0.8 or more (or of another ``kind``), columns as they came.

    Candidates come from wide fingerprints, of which a pair at 0.8 is missed with a chance of MISS
    and of SLACK standard errors whatever the table's size; what links is settled on the shingles
    themselves. Groups are connected by such pairs. Texts of equal shingles count as one,
    texts without words too. Rows that agree in doc_id and text are copies, of which one stays;
    rows that share a doc_id only are told apart by their texts. Rows without a doc_id stay. An
    empty table gives an empty one.
    """
    named = docs.where("doc_id is not null")
    judged = _judged(named.select("doc_id", "text"), kind or similar(named.count()))
    made, of_class = (x.df for x in judged)
    ranked = made.groupBy("node", "doc_id", "row").agg(F.count("*").alias("copies")).join(of_class.select("node", "component"), "node")
    first = ranked.groupBy("component").agg(F.min(F.struct("doc_id", "row", "copies")).alias("first")).select("first.*")
    first = stage(first.select(F.col("doc_id").alias("_kept"), F.col("row").alias("_row"), F.col("copies").alias("_copies")), "simhash-first").df
    for x in judged:
        x.release()
    nested = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    pick = lambda test: nested.join(first.where(test), (F.col("_id") == F.col("_kept")) & (F.col("_text") == F.col("_row")), "left_semi")
    kept = pick("_copies = 1").select("row.*").union(docs.where("doc_id is null"))
    again = "_copies > 1"
    if not first.where(again).isEmpty():
        kept = kept.union(pick(again).dropDuplicates(["_id", "_text"]).select("row.*"))
    made = stage(kept, "simhash-kept").df  # packed; the shuffle of whole texts would lie there for as long as its result is held
    del kept
    free_shuffles(docs.sparkSession)
    return made
