"""Resampling tests: exact-stream versions in numpy by group, and hash-ordered ones in SQL functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import signed_rank_tail
from ..schema import PATTERNS
from ..sources.scratch import staged

REPLICATES = 20_000


def chi_square_of(table: np.ndarray) -> float:
    """Pearson's statistic of a count table, empty columns left out."""
    table = np.asarray(table, float)[:, np.sum(table, axis=0) > 0]
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    return float(((table - expected) ** 2 / expected).sum())


def permuted_labels(table: np.ndarray, seed: int, replicates: int = REPLICATES) -> float:
    """Permutation p of groups x categories: every count is one labelled draw; draws are shuffled and cut at the group sizes."""
    table = np.asarray(table, np.int64)
    table = table[:, table.any(axis=0)]
    sizes, kinds = table.sum(axis=1), table.sum(axis=0)
    labels = np.concatenate([np.full(n, k) for k, n in enumerate(kinds)])
    cuts, expected = np.cumsum(sizes)[:-1], np.outer(sizes, kinds) / table.sum()
    statistic = lambda t: ((t - expected) ** 2 / expected).sum()
    seen, hits, rng = statistic(table), 0, np.random.default_rng(seed)
    for _ in range(replicates):
        rng.shuffle(labels)
        hits += statistic(np.stack([np.bincount(x, minlength=len(kinds)) for x in np.split(labels, cuts)])) >= seen
    return (hits + 1) / (replicates + 1)


def permuted_clusters(clusters: np.ndarray, sizes: list[int], seed: int, replicates: int = REPLICATES) -> float:
    """Permutation p of whole clusters (rows of counts, by group): cluster numbers per group stay as they are."""
    cuts = np.cumsum(sizes)[:-1]
    total = lambda rows: np.stack([part.sum(axis=0) for part in np.split(rows, cuts)])
    seen, rng = chi_square_of(total(clusters)), np.random.default_rng(seed)
    hits = sum(chi_square_of(total(clusters[rng.permutation(len(clusters))])) >= seen for _ in range(replicates))
    return (hits + 1) / (replicates + 1)


def swapped_pairs(a: np.ndarray, b: np.ndarray, seed: int, replicates: int = REPLICATES) -> float:
    """Paired permutation p: each pair's two count vectors change places with chance one half."""
    seen, hits, rng = chi_square_of(np.stack([a.sum(axis=0), b.sum(axis=0)])), 0, np.random.default_rng(seed)
    for _ in range(replicates):
        swap = (rng.random(len(a)) < 0.5)[:, None]
        hits += chi_square_of(np.stack([np.where(swap, b, a).sum(axis=0), np.where(swap, a, b).sum(axis=0)])) >= seen
    return (hits + 1) / (replicates + 1)


def bootstrap(clusters: np.ndarray, rng: np.random.Generator, replicates: int = REPLICATES) -> dict[str, float]:
    """2.5 and 97.5 percentiles of SVO share and entropy over clusters drawn with replacement."""
    shares, entropies = np.empty(replicates), np.empty(replicates)
    for i in range(replicates):
        p = clusters[rng.integers(0, len(clusters), len(clusters))].sum(axis=0)
        p = p / p.sum()
        shares[i] = p[0]
        entropies[i] = -(p[p > 0] * np.log(p[p > 0])).sum()
    (a, b), (c, d) = np.percentile(shares, [2.5, 97.5]), np.percentile(entropies, [2.5, 97.5])
    return {"svo_lo": a, "svo_hi": b, "entropy_lo": c, "entropy_hi": d}


def exact_pair_tests(pairs: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``(group_a, group_b, chi2, p)`` of ``pairs(group_a, group_b, a, b, seed)``: each pair has its own stream, so
    pairs run side by side with the same results."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            table = np.stack([r.a, r.b]).astype(np.int64)
            out.append((r.group_a, r.group_b, chi_square_of(table), permuted_labels(table, int(r.seed), replicates)))
        return pd.DataFrame(out, columns=["group_a", "group_b", "chi2", "p"])

    return pairs.groupBy("group_a", "group_b").applyInPandas(run, "group_a string, group_b string, chi2 double, p double")


def exact_group_tests(tables: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``(name, chi2, p)`` of ``tables(name, cells, seed)``, ``cells`` an array of count vectors: any number of groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.name_, chi_square_of(np.stack(list(r.cells))), permuted_labels(np.stack(list(r.cells)), int(r.seed), replicates)) for r in rows.rename(columns={"name": "name_"}).itertuples()]
        return pd.DataFrame(out, columns=["name", "chi2", "p"])

    return tables.groupBy("name").applyInPandas(run, "name string, chi2 double, p double")


def _vectors(rows: pd.DataFrame, prefix: str = "n_") -> np.ndarray:
    return rows[[f"{prefix}{p}" for p in PATTERNS]].to_numpy(np.int64)


def exact_cluster_tests(clusters: DataFrame, families: DataFrame, unit: str, group: str, replicates: int = REPLICATES) -> DataFrame:
    """``(name, clusters, chi2, p)`` for each row of ``families(name, members, seed)``: whole clusters of two groups or more are permuted.

    ``clusters`` has six counts ``n_*`` for each unit. numpy's stream is over the family's clusters
    in the order of members, then units, so a family is one task's work and its clusters must fit
    there (48 bytes each).
    """
    member = families.select("name", "seed", F.posexplode("members").alias("place", "_group"))
    rows = clusters.join(F.broadcast(member), F.col(group) == F.col("_group"))  # a few rows of families

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", unit])
        sizes = rows.groupby("place").size().tolist()
        counts = _vectors(rows)
        total = np.stack([x.sum(axis=0) for x in np.split(counts, np.cumsum(sizes)[:-1])])
        return pd.DataFrame([(rows["name"].iloc[0], len(rows), chi_square_of(total), permuted_clusters(counts, sizes, int(rows["seed"].iloc[0]), replicates))], columns=["name", "clusters", "chi2", "p"])

    kept = rows.select("name", "seed", "place", unit, *[f"n_{p}" for p in PATTERNS])
    return kept.groupBy("name").applyInPandas(run, "name string, clusters long, chi2 double, p double")


def exact_swap_test(pairs: DataFrame, unit: str, a: list[str], b: list[str], seed: int, replicates: int = REPLICATES) -> DataFrame:
    """``(pairs, chi2, p)``: the sides of each pair, counts in the columns ``a`` and ``b``, change places by numpy's stream in the order of units."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(unit)
        x, y = rows[a].to_numpy(np.int64), rows[b].to_numpy(np.int64)
        return pd.DataFrame([(len(rows), chi_square_of(np.stack([x.sum(axis=0), y.sum(axis=0)])), swapped_pairs(x, y, seed, replicates))], columns=["pairs", "chi2", "p"])

    one = pairs.select(unit, *a, *b).withColumn("_all", F.lit(0))
    return one.groupBy("_all").applyInPandas(run, "pairs long, chi2 double, p double")


def exact_bootstrap(clusters: DataFrame, groups: tuple[str, ...], unit: str, group: str, seed: int, replicates: int = REPLICATES) -> DataFrame:
    """``(group, clusters, svo_lo, svo_hi, entropy_lo, entropy_hi)``: groups in the given order share one of numpy's streams."""
    names = ["svo_lo", "svo_hi", "entropy_lo", "entropy_hi"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rng, out = np.random.default_rng(seed), []
        for g in groups:
            own = rows[rows[group] == g].sort_values(unit)
            if len(own):
                found = bootstrap(_vectors(own), rng, replicates)
                out.append((g, len(own), *[found[k] for k in names]))
        return pd.DataFrame(out, columns=[group, "clusters", *names])

    one = clusters.where(F.col(group).isin(*groups)).select(unit, group, *[f"n_{p}" for p in PATTERNS]).withColumn("_all", F.lit(0))
    return one.groupBy("_all").applyInPandas(run, f"{group} string, clusters long, {', '.join(f'{k} double' for k in names)}")


def signed_ranks(differences: DataFrame, group: str, d: str) -> DataFrame:
    """``(group, n, w_plus, w_minus, w, ties)``: ranks of absolute differences, ties averaged, zeros dropped.

    Equal sizes are counted before anything is ordered, so what a group's window holds is its distinct sizes.
    """
    sizes = differences.where(F.col(d) != 0).groupBy(group, F.abs(d).alias("_size")).agg(F.count("*").alias("k"), F.count_if(F.col(d) > 0).alias("up"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(group).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_rank", before + (F.col("k") + 1) / 2)
    k = F.col("k").cast("double")
    out = ranked.groupBy(group).agg(
        F.sum("k").alias("n"), F.sum(F.col("_rank") * F.col("up")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(k * k * k - k).alias("ties")
    )
    return out.withColumn("w", F.least("w_plus", "w_minus"))


def wilcoxon_p(differences: DataFrame, group: str, d: str) -> DataFrame:
    """``(group, w, p)`` of the signed-rank test by its normal approximation."""
    return signed_ranks(differences, group, d).select(group, "w", signed_rank_tail("w", "n", "ties").alias("p"))


def hash_order(replicate: Column, unit: Column) -> Column:
    return F.md5(F.concat_ws("-", replicate.cast("string"), unit.cast("string")).cast("binary"))


#: Hexadecimal digits of a hash by which units are dealt before they are ordered.
DIGITS = 2


def hash_permuted(units: DataFrame, unit: str, group: str, replicates: int = REPLICATES, by: tuple[str, ...] = ()) -> DataFrame:
    """``units`` under each replicate with ``drawn``: the group's labels in the order of hashes of (replicate, unit).

    Replicate 0 is the observed assignment; with ``by``, units are permuted within each value of
    these columns. A unit's label is the one whose share of places its place falls into. Buckets of
    the hash (16 to the power of DIGITS) are counted; where all places of a bucket have one label
    its units get that without being ordered or moved, so only buckets in which a share ends, one
    fewer than there are labels at most, are shuffled and ordered. ``units`` is read several times:
    stage it where it is dear.
    """
    each = units.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    h = hash_order(F.col("replicate"), F.col(unit))
    each = each.select("*", h.alias("_h")).withColumn("_bucket", F.substring("_h", 1, DIGITS))
    keys = [*by, "replicate"]
    sizes = each.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    labels = units.groupBy(*by, group).agg(F.count("*").alias("_n"))  # a few rows
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(group))
    cuts = labels.withColumn("_upto", upto).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_upto", F.col(group).alias("_label")))).alias("_cuts"))
    cut = lambda df: df.join(F.broadcast(cuts), list(by)) if by else df.crossJoin(F.broadcast(cuts))  # noqa: E731  # one row for each value of ``by``
    label = lambda place: F.get(F.filter("_cuts", lambda c: place <= c["_upto"]), F.lit(0))
    placed = cut(sizes.select(*keys, "_bucket", "_n", before.alias("_before")))
    first, last = label(F.col("_before") + 1), label(F.col("_before") + F.col("_n"))
    placed = staged(placed.select(*keys, "_bucket", "_before", first.alias("_first"), (first["_upto"] == last["_upto"]).alias("_one")), "buckets")
    whole = placed.where("_one").groupBy(*keys, "_first").agg(F.min("_bucket").alias("_low"), F.max("_bucket").alias("_high"))
    whole = whole.groupBy(*keys).agg(F.collect_list(F.struct("_low", "_high", F.col("_first._label").alias("_label"))).alias("_whole"))
    ends = placed.where("not _one").groupBy(*keys).agg(F.collect_list(F.struct("_bucket", "_before")).alias("_ends"))
    plan = cut(whole.join(ends, keys, "full_outer"))  # a row for each replicate and value of ``by``
    drawn = each.join(F.broadcast(plan), keys)
    mine = F.get(F.filter("_ends", lambda x: x["_bucket"] == F.col("_bucket")), F.lit(0))
    share = F.get(F.filter("_whole", lambda x: (x["_low"] <= F.col("_bucket")) & (F.col("_bucket") <= x["_high"])), F.lit(0))
    ended = F.exists(F.coalesce("_ends", F.array().cast("array<struct<_bucket:string,_before:bigint>>")), lambda x: x["_bucket"] == F.col("_bucket"))
    settled = drawn.where(~ended).select(*units.columns, "replicate", share["_label"].alias("drawn"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_h", unit))
    ordered = drawn.where(ended).select(*units.columns, "replicate", "_bucket", "_h", "_cuts", mine["_before"].alias("_before")).withColumn("_at", F.col("_before") + within)
    ordered = ordered.select(*units.columns, "replicate", label(F.col("_at"))["_label"].alias("drawn"))
    return settled.unionByName(ordered).unionByName(units.select("*", F.lit(0).alias("replicate"), F.col(group).alias("drawn")))


def permutation_p(statistics: DataFrame, value: str, *by: str) -> DataFrame:
    """``(by..., chi2, hits, replicates, p)`` from statistics by replicate, 0 being the observed; compared at 9 places."""
    x = F.round(value, 9)
    seen = statistics.where("replicate = 0").select(*by, x.alias("chi2"))  # one row for each value of ``by``
    drawn = statistics.where("replicate > 0").select(*by, x.alias("_x"))
    drawn = drawn.join(F.broadcast(seen), list(by)) if by else drawn.crossJoin(F.broadcast(seen))
    out = drawn.groupBy(*by, "chi2").agg(F.count_if(F.col("_x") >= F.col("chi2")).alias("hits"), F.count("*").alias("replicates"))
    return out.select(*by, "chi2", "hits", "replicates", ((F.col("hits") + 1) / (F.col("replicates") + 1)).alias("p"))


def table_chi2(cells: DataFrame, by: list[str], row: str, column: str, n: str = "n") -> DataFrame:
    """Pearson's statistic of each table in long form ``(by..., row, column, n)``; absent cells count as 0."""
    rows = cells.groupBy(*by, row).agg(F.sum(n).alias("_r"))
    columns = cells.groupBy(*by, column).agg(F.sum(n).alias("_c"))
    total = cells.groupBy(*by).agg(F.sum(n).alias("_t"))
    grid = rows.join(columns, by).join(total, by).join(cells, [*by, row, column], "left")
    e = F.col("_r") * F.col("_c") / F.col("_t")
    o = F.coalesce(F.col(n), F.lit(0))
    return grid.where("_r > 0 and _c > 0").groupBy(*by).agg(F.sum((o - e) * (o - e) / e).alias("chi2"))


#: P(X <= k) of a Poisson distribution of mean 1, k = 0 .. 9.
POISSON = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]
