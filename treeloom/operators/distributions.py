"""Distributions over the six orders: filling, shares, entropy, dominance and pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import PATTERNS, pattern_rank


def patterns_of(groups: DataFrame) -> DataFrame:
    """Every group with every pattern, without a join."""
    return groups.select("*", F.explode(F.array(*[F.lit(p) for p in PATTERNS])).alias("pattern"))


def zero_filled(counts: DataFrame, *groups: str) -> DataFrame:
    """Six rows a group, with totals and proportions (0 where the total is 0)."""
    wide = to_wide(counts, *groups)
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n_{p}").alias("n")) for p in PATTERNS])
    return wide.select(*groups, F.inline(rows), "total").withColumn("proportion", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0))


def to_wide(counts: DataFrame, *groups: str) -> DataFrame:
    """``(groups..., n_SVO ... n_OVS, total)``."""
    cells = [F.coalesce(F.sum(F.when(F.col("pattern") == p, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{p}") for p in PATTERNS]
    return counts.groupBy(*groups).agg(*cells).withColumn("total", sum((F.col(f"n_{p}") for p in PATTERNS), F.lit(0)).cast("long"))


def vector(prefix: str = "n_") -> Column:
    return F.array(*[F.col(f"{prefix}{p}").cast("double") for p in PATTERNS])


def entropy(shares: Column) -> Column:
    """Shannon entropy in nats over positive shares."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def shares_of(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2."""
    parts = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def cosine(p: Column, q: Column) -> Column:
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return add(F.zip_with(p, q, lambda a, b: a * b)) / F.sqrt(add(F.transform(p, lambda a: a * a)) * add(F.transform(q, lambda b: b * b)))


def chi_square(rows: list[Column]) -> dict[str, Column]:
    """Pearson's chi-square of a table of count vectors without its empty columns: chi2, df, least expected cell,
    cells expected under 5, Cramer's V."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    columns = rows[0]
    for r in rows[1:]:
        columns = F.zip_with(columns, r, lambda a, b: a + b)
    total = add(columns)
    filled = F.size(F.filter(columns, lambda x: x > 0))
    chi2, least, small = F.lit(0.0), F.lit(float("inf")), F.lit(0)

    def expected_of(size: Column) -> Column:
        return F.transform(columns, lambda c: c * size / total)

    for r in rows:
        expected = expected_of(add(r))
        parts = F.zip_with(r, expected, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0))
        positive = F.filter(expected, lambda e: e > 0)
        chi2, least = chi2 + add(parts), F.least(least, F.array_min(positive))
        small = small + F.size(F.filter(positive, lambda e: e < 5))
    narrow = F.least(F.lit(len(rows)), filled) - 1
    return {"chi2": chi2, "df": (len(rows) - 1) * (filled - 1), "min_expected": least, "n_small": small, "cramers_v": F.sqrt(chi2 / (total * narrow))}


def dominance(wide: DataFrame) -> DataFrame:
    """Adds entropy, the most frequent order (ties to the canonical first) and whether it leads more than twice."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"n_{p}")).alias("minus"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PATTERNS)]))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return wide.withColumns(
        {
            "entropy": entropy(shares_of(vector())),
            "dominant_order": first["p"],
            "dominant": (second["minus"] == 0) | (-first["minus"] > -2 * second["minus"]),
            "top_ratio": F.when(second["minus"] < 0, first["minus"] / second["minus"]),
        }
    )


def pairs(wide: DataFrame, group: str) -> DataFrame:
    """Each unordered pair of groups once: group_a < group_b with vectors a, b.

    Groups are corpora (tens, not rows); the list of them is gathered once and taken apart by place.
    """
    gathered = wide.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), vector().alias("x")))).alias("all"))
    first = gathered.select("all", F.posexplode("all").alias("i", "a"))
    both = first.select("a", F.explode_outer(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b")).where("b is not null")
    return both.select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), F.col("a.x").alias("a"), F.col("b.x").alias("b"))


def holm(p_values: DataFrame, family: str, key: str, p: str = "p") -> DataFrame:
    """Adds ``p_holm``: step-down adjusted p-values within each family, at most 1 and never falling."""
    order = Window.partitionBy(family).orderBy(p, key)
    m, rank = F.count("*").over(Window.partitionBy(family)), F.row_number().over(order)
    raw = p_values.withColumn("_raw", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return raw.withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def canonical(df: DataFrame, *before: str) -> DataFrame:
    return df.orderBy(*before, pattern_rank(F.col("pattern")))
