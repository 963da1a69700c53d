"""Resampling without a row for each unit and replicate.

A task adds its units to replicate matrices, one row of sums for each replicate, and the partial
matrices are merged by an aggregation: what is shuffled grows with replicates and tasks, not with
units. What a unit gets in a replicate comes from a counter-based generator keyed by both, so
results depend on neither layout nor order. Permutations of single counts need no units at all:
they are drawn from a table's margins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import generated
from ..sources.scratch import staged
from .inference import POISSON, REPLICATES

#: The increment and multipliers of the splitmix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Numbers that a task draws at once, and the groups whose matrices it holds before it hands them on.
HELD, GROUPS = 1 << 21, 64
#: How often a unit is taken for each value of 16 random bits: Poisson of mean 1, to that precision.
TAKEN = np.searchsorted(np.array(POISSON) * 65536, np.arange(65536), side="right").astype(np.uint8)
#: Units that one task orders in a permutation, until there are MOST buckets, whose sizes the driver knows.
BUCKET, MOST = 2048, 1 << 16
#: numpy draws from no larger urn; beyond it the normal approximation's error is far below a replicate's.
URN = 10**9


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalising mix of splitmix64, over 64-bit unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """64 random bits for each counter (rows) and key (columns)."""
    return mixed(mixed(keys.astype(np.uint64))[None, :] + (counters.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(STEP))


def poisson_weights(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """How often each unit is taken in the four replicates of each counter, as rows of replicates."""
    lanes = draws(keys, counters).astype("<u8").view("<u2").reshape(len(counters), len(keys), 4)
    return TAKEN[lanes].transpose(0, 2, 1).reshape(-1, len(keys))


def swap_bits(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """0 or 1 for each unit in the 64 replicates of each counter, as rows of replicates."""
    raw = draws(keys, counters).astype("<u8").view(np.uint8).reshape(len(counters), len(keys), 8)
    return np.unpackbits(raw, axis=2, bitorder="little").transpose(0, 2, 1).reshape(-1, len(keys))


#: Replicates of one counter, by how units are drawn.
LANES = {poisson_weights: 4, swap_bits: 64}


def key_of(unit: Column, numbers: bool) -> Column:
    """A unit's 64-bit key: itself if it is a number, else its hash."""
    return unit.cast("long") if numbers else F.xxhash64(unit)


def weighted_sums(units: DataFrame, unit: str, values: list[str], by: list[str], weights, replicates: int = REPLICATES) -> DataFrame:
    """``(by..., replicate, values...)``: in each replicate, the sums of ``values`` over units by their ``weights``, replicates from 1.

    A task holds ``replicates`` times the values for each of GROUPS groups at most. Sums are exact
    below 2^53. Rows of one unit are taken alike; a null unit is a unit. No units, no rows.
    """
    numbers = dict(units.dtypes)[unit] in ("tinyint", "smallint", "int", "bigint")
    lanes = LANES[weights]
    counters = -(-replicates // lanes)
    schema = units.select(F.struct(*by, F.lit(0)).alias("by")).schema["by"].dataType
    rows = units.select(F.to_json(F.struct(*by, F.lit(0).alias("_"))).alias("by"), F.coalesce(key_of(F.col(unit), numbers), F.lit(-1)).alias("key"), *[F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    names = [f"v{i}" for i in range(len(values))]

    def told(group: str, sums: np.ndarray) -> pa.RecordBatch:
        whole = sums[:replicates]
        return pa.RecordBatch.from_arrays([pa.array([group] * len(whole), pa.string()), pa.array(np.arange(1, len(whole) + 1, dtype=np.int64)), *[pa.array(whole[:, i].astype(np.int64)) for i in range(len(values))]], ["by", "replicate", *names])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes, keys = groups.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(values))], axis=1).astype(np.float64)
            for code, group in enumerate(groups.dictionary.to_pylist()):
                own = codes == code
                if group not in held:
                    if len(held) >= GROUPS:
                        yield from (told(g, s) for g, s in held.items())
                        held.clear()
                    held[group] = np.zeros((counters * lanes, len(values)))
                some, mine = keys[own], counts[own]
                step = max(1, HELD // (lanes * len(some)))
                for a in range(0, counters, step):
                    at = np.arange(a, min(a + step, counters))
                    held[group][a * lanes : (a + len(at)) * lanes] += weights(some, at).astype(np.float64) @ mine
        yield from (told(g, s) for g, s in held.items())

    made = rows.mapInArrow(run, f"by string, replicate long, {', '.join(f'{n} long' for n in names)}")
    merged = made.groupBy("by", "replicate").agg(*[F.sum(n).alias(n) for n in names])
    parsed = merged.withColumn("by", F.from_json("by", schema))
    return parsed.select(*[F.col("by").getField(b).alias(b) for b in by], "replicate", *[F.col(n).alias(v) for n, v in zip(names, values, strict=True)])


def bootstrap_sums(units: DataFrame, unit: str, values: list[str], by: list[str], replicates: int = REPLICATES) -> DataFrame:
    """Sums of a Poisson bootstrap: each unit is taken none, one or several times in each replicate."""
    return weighted_sums(units, unit, values, by, poisson_weights, replicates)


def swapped_sums(pairs: DataFrame, unit: str, a: list[str], b: list[str], by: list[str], replicates: int = REPLICATES) -> DataFrame:
    """``(by..., replicate, a..., b...)``: the sums of both sides, replicate 0 as observed, in the others each pair's sides change places
    with chance one half."""
    gaps = pairs.select("*", *[(F.col(y) - F.col(x)).alias(f"_gap{i}") for i, (x, y) in enumerate(zip(a, b, strict=True))])
    moved = weighted_sums(gaps, unit, [f"_gap{i}" for i in range(len(a))], by, swap_bits, replicates)
    seen = pairs.groupBy(*by).agg(*[F.sum(x).cast("long").alias(x) for x in (*a, *b)])
    on = [F.col(x).eqNullSafe(F.col(f"_by_{x}")) for x in by]
    whole = moved.select(*[F.col(x).alias(f"_by_{x}") for x in by], "replicate", *[f"_gap{i}" for i in range(len(a))])
    # a row for each group by its replicates
    whole = seen.join(whole, on) if by else whole.crossJoin(F.broadcast(seen))
    drawn = whole.select(*by, "replicate", *[(F.col(x) + F.col(f"_gap{i}")).alias(x) for i, x in enumerate(a)], *[(F.col(y) - F.col(f"_gap{i}")).alias(y) for i, y in enumerate(b)])
    return drawn.unionByName(seen.withColumn("replicate", F.lit(0).cast("long")))


def bucket_takes(sizes: np.ndarray, bucket: int, labels: list[int], seed: int, replicates: int) -> np.ndarray:
    """``(labels - 1, replicates)``: how many units of a bucket get each label but the last, when ``labels`` units of each are dealt
    over all buckets at random.

    The buckets are halved down to this one; in each halving the labels' numbers are split by a
    stream keyed by the halving, so every bucket's task sees the same splits above it.
    """
    totals, lo, hi = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    takes = np.repeat(np.array(labels[:-1], np.int64)[:, None], replicates, axis=1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, right = int(totals[mid] - totals[lo]), int(totals[hi] - totals[mid])
        rng, first = np.random.default_rng([seed, lo, hi]), np.zeros_like(takes)
        room_left, room_right = np.full(replicates, left), np.full(replicates, right)
        for k, take in enumerate(takes):  # one label after another, from what room is left
            first[k] = _split_rooms(take, room_left, room_right, rng)
            room_left, room_right = room_left - first[k], room_right - (take - first[k])
        takes, lo, hi = (first, lo, mid) if bucket < mid else (takes - first, mid, hi)
    return takes


def _split_rooms(take: np.ndarray, left: np.ndarray, right: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    if len(take) and int((left + right).max()) < URN:
        return rng.hypergeometric(left, right, take)
    n = np.maximum(left + right, 1)
    p = left / n
    sd = np.sqrt(np.maximum(0, take * p * (1 - p) * (n - take) / np.maximum(1, n - 1)))
    drawn = np.rint(take * p + sd * rng.standard_normal(len(take))).astype(np.int64)
    return np.clip(drawn, np.maximum(0, take - right), np.minimum(take, left))


def permuted_sums(units: DataFrame, unit: str, values: list[str], by: list[str], group: str, seed: int, replicates: int = REPLICATES) -> DataFrame:
    """``(by..., replicate, group, values...)``: sums by group when whole units are dealt to the groups anew, as many to each as observed.

    Replicate 0 is as observed. Units are dealt into buckets of about BUCKET by their hash; how
    many of a bucket each group gets follows from ``bucket_takes``, and which they are from the
    least draws of the bucket's units, so a bucket is all that a task holds. ``by`` and ``group``
    have few values (their sizes reach the driver); nulls in them are values.
    """
    numbers = dict(units.dtypes)[unit] in ("tinyint", "smallint", "int", "bigint")
    name = F.to_json(F.struct(*by, F.lit(0).alias("_")))
    schema = units.select(F.struct(*by, F.lit(0)).alias("by")).schema["by"].dataType
    label = F.to_json(F.struct(F.col(group).alias("g"), F.lit(0).alias("_")))
    label_schema = units.select(F.struct(F.col(group).alias("g"), F.lit(0)).alias("x")).schema["x"].dataType
    rows = units.select(name.alias("by"), label.alias("label"), F.coalesce(key_of(F.col(unit), numbers), F.lit(-1)).alias("key"), *[F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    rows = staged(rows, "permuted")  # read four times
    dealt: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("by", "label").count().collect():  # groups, not units
        dealt.setdefault(r["by"], {})[r["label"]] = r["count"]
    plans = {b: (sorted(n), min(MOST, max(1, sum(n.values()) // BUCKET))) for b, n in dealt.items()}
    buckets = F.create_map(*[F.lit(x) for b, (_, k) in plans.items() for x in (b, k)]) if plans else F.create_map(F.lit("{}"), F.lit(1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.element_at(buckets, F.col("by")).cast("long")))
    sizes = {b: np.zeros(k, np.int64) for b, (_, k) in plans.items()}
    for r in rows.groupBy("by", "bucket").count().collect():  # MOST rows a group at most
        sizes[r["by"]][r["bucket"]] = r["count"]
    shipped = units.sparkSession.sparkContext.broadcast((dealt, plans, sizes))
    names = [f"v{i}" for i in range(len(values))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        dealt, plans, sizes = shipped.value
        which, bucket = frame["by"].iloc[0], int(frame["bucket"].iloc[0])
        labels = plans[which][0]
        frame = frame.sort_values(["key", *names])
        again = frame.groupby("key").cumcount().to_numpy(np.uint64)  # rows of one unit draw apart
        keys, counts = frame["key"].to_numpy(np.int64).view(np.uint64) + again * np.uint64(FIRST), frame[names].to_numpy(np.float64)
        takes = np.cumsum(bucket_takes(sizes[which], bucket, [dealt[which][x] for x in labels], seed, replicates), axis=0)
        out = np.empty((len(labels), replicates, len(values)))
        total, step = counts.sum(axis=0), max(1, HELD // len(keys))
        for a in range(0, replicates, step):
            drawn = draws(keys, np.arange(a, min(a + step, replicates)) + seed)
            ordered = np.sort(drawn, axis=1)
            below = np.zeros((len(drawn), len(values)))
            for k in range(len(labels) - 1):
                need = takes[k, a : a + len(drawn)]
                cut = np.where(need > 0, ordered[np.arange(len(drawn)), np.maximum(need, 1) - 1], 0)
                reach = ((drawn <= cut[:, None]) & (need > 0)[:, None]).astype(np.float64) @ counts
                out[k, a : a + len(drawn)] = reach - below
                below = reach
            out[-1, a : a + len(drawn)] = total - below
        made = pd.DataFrame(out.reshape(-1, len(values)).astype(np.int64), columns=names)
        return made.assign(by=which, label=np.repeat(labels, replicates), replicate=np.tile(np.arange(1, replicates + 1), len(labels)))[["by", "label", "replicate", *names]]

    kinds = f"by string, label string, replicate long, {', '.join(f'{n} long' for n in names)}"
    drawn = rows.select("by", "bucket", "key", *names).groupBy("by", "bucket").applyInPandas(run, kinds)
    seen = rows.select("by", "label", F.lit(0).cast("long").alias("replicate"), *names)
    merged = drawn.unionByName(seen).groupBy("by", "label", "replicate").agg(*[F.sum(n).alias(n) for n in names])
    parsed = merged.withColumn("by", F.from_json("by", schema)).withColumn("label", F.from_json("label", label_schema))
    return parsed.select(*[F.col("by").getField(b).alias(b) for b in by], "replicate", F.col("label").getField("g").alias(group), *[F.col(n).alias(v) for n, v in zip(names, values, strict=True)])


def table_statistics(sums: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``(by..., chi2)``: Pearson's statistic of each table whose rows are the groups' sums; empty rows and columns count nothing."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rows = sums.groupBy(*by).agg(F.collect_list(F.array(*[F.col(v).cast("double") for v in values])).alias("cells"), F.array(*[F.sum(v).cast("double") for v in values]).alias("columns"))
    whole = generated(rows, [*by, "cells", "columns"], total=add(F.col("columns")))

    def part(row):
        share = add(row) / F.col("total")
        return add(F.zip_with(row, "columns", lambda o, c: F.when(c * share > 0, (o - c * share) * (o - c * share) / (c * share)).otherwise(0.0)))

    return whole.select(*by, add(F.transform("cells", part)).alias("chi2"))


#: Replicates that a task draws for one table.
BLOCK = 2_000


def drawn_tables(table: np.ndarray, rng: np.random.Generator, replicates: int) -> np.ndarray:
    """``(replicates, groups, categories)``: tables with the margins of ``table``, as its single counts fall when their labels are shuffled.

    One group after another takes its share of what is left in each category: a conditional
    hypergeometric draw for each, and no pool of labels.
    """
    sizes, rest = table.sum(axis=1), np.repeat(table.sum(axis=0)[None, :], replicates, axis=0)
    out = np.empty((replicates, *table.shape), np.int64)
    for g in range(len(table) - 1):
        need = np.full(replicates, sizes[g])
        others = rest.sum(axis=1)
        for k in range(table.shape[1]):
            others = others - rest[:, k]
            out[:, g, k] = got = _split_rooms(need, rest[:, k], others, rng)
            need = need - got
        rest = rest - out[:, g]
    out[:, -1] = rest
    return out


def count_permutations(tables: DataFrame, by: list[str], cells: str, seed: int, replicates: int = REPLICATES) -> DataFrame:
    """``(by..., chi2, hits, replicates, p)`` of tables of counts (groups of categories): how often shuffled labels give as large a statistic.

    Tables are small rows; their replicates are dealt out in blocks, each with a stream of its
    own, and only numbers of hits come back. Statistics are compared at 9 places. Empty groups
    and categories are left out; a table of less than two of either has a statistic and hits of
    every replicate at nought.
    """
    schema = tables.select(F.struct(*by, F.lit(0)).alias("by")).schema["by"].dataType
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // BLOCK) - 1))
    rows = tables.select(F.to_json(F.struct(*by, F.lit(0).alias("_"))).alias("by"), F.col(cells).cast("array<array<long>>").alias("cells"), F.explode(blocks).alias("block"))

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                table = np.stack([np.asarray(x, np.int64) for x in r.cells])
                table = table[table.any(axis=1)][:, table.any(axis=0)]
                n = min(BLOCK, replicates - r.block * BLOCK)
                if min(table.shape) < 2:
                    out.append((r.by, 0.0, n, n))
                    continue
                expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
                statistic = lambda t: np.round((((t - expected) ** 2) / expected).sum(axis=(-2, -1)), 9)  # noqa: B023, E731
                name = int.from_bytes(hashlib.blake2b(r.by.encode(), digest_size=8).digest(), "little")
                rng, seen = np.random.default_rng([seed, name, r.block]), float(statistic(table))
                out.append((r.by, seen, int((statistic(drawn_tables(table, rng, n)) >= seen).sum()), n))
            yield pd.DataFrame(out, columns=["by", "chi2", "hits", "n"])

    # a row a block: dealt out, as they are few and long
    told = rows.repartition(min(200, max(1, -(-replicates // BLOCK))), "by", "block").mapInPandas(run, "by string, chi2 double, hits long, n long")
    merged = told.groupBy("by").agg(F.max("chi2").alias("chi2"), F.sum("hits").alias("hits"), F.sum("n").alias("replicates")).withColumn("by", F.from_json("by", schema))
    return merged.select(*[F.col("by").getField(b).alias(b) for b in by], "chi2", "hits", "replicates", ((F.col("hits") + 1) / (F.col("replicates") + 1)).alias("p"))
