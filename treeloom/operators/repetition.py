"""Exact-text repetition: first occurrences, counts before and after, audit and claim stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import PATTERNS


def first_occurrence(rows: DataFrame, identity: str, *order: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``is_first``: the row of least order among those of one identity (bytes as they are) in its scope.

    The least order of an identity is aggregated before it is shuffled, and the rows are joined
    to these by their order alone, so no identity's rows meet in one task; ``order`` tells the
    rows of a scope apart. Null identities are one identity.
    """
    keys = [*scope, *order]
    first = rows.groupBy(*scope, digest(F.col(identity)).alias("_d")).agg(F.min(F.struct(*order)).alias("_o"))
    first = first.select(F.lit(True).alias("_first"), *[F.col(k).alias(f"_k_{k}") for k in scope], *[F.col(f"_o.{k}").alias(f"_k_{k}") for k in order])
    joined = rows.join(first, [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return joined.withColumn("is_first", F.coalesce("_first", F.lit(False))).drop("_first", *[f"_k_{k}" for k in keys])


def digest(identity: Column) -> Column:
    """16 bytes that stand for a text of any length as a key (null for null)."""
    return F.unhex(F.md5(identity.cast("binary")))


def counts_before_after(rows: DataFrame, identity: str, *order: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """``(scope..., before_SVO ..., after_SVO ...)``: the sums of the six counts over all rows and over first occurrences.

    One shuffle: an identity's sums and its first row's counts are aggregated together, the text by its digest.
    """
    sums = [F.sum(f"n_{p}").alias(f"all_{p}") for p in PATTERNS]
    kinds = rows.groupBy(*scope, digest(F.col(identity)).alias("_d")).agg(*sums, F.min(F.struct(F.struct(*order).alias("at"), *[F.col(f"n_{p}") for p in PATTERNS])).alias("_first"))
    parts = [(f"before_{p}", F.col(f"all_{p}")) for p in PATTERNS] + [(f"after_{p}", F.col(f"_first.n_{p}")) for p in PATTERNS]
    return kinds.groupBy(*scope).agg(*[F.sum(c).cast("long").alias(k) for k, c in parts])


def repetition_counts(rows: DataFrame, identity: str, *groups: str, fallback: str | None = None) -> DataFrame:
    """``(groups..., total, unique, duplicates, pct)`` exactly, over identities counted first; with ``fallback``, a column that says
    whether a row's identity was made up from its tokens, also how many were."""
    more = [F.count_if(F.col(fallback)).alias("f")] if fallback else []
    kinds = rows.groupBy(*groups, identity).agg(F.count("*").alias("k"), *more)
    out = kinds.groupBy(*groups).agg(F.sum("k").alias("total"), F.count("*").alias("unique_n"), *([F.sum("f").alias("fallbacks")] if fallback else []))
    return out.withColumn("duplicates", F.col("total") - F.col("unique_n")).withColumn("pct", 100 * F.col("duplicates") / F.col("total"))


def audit(rows: DataFrame, identity: str, *order: str, fallback: str | None = None) -> DataFrame:
    """One row for each identity that repeats, of rows with six counts ``n_*``: occurrences, mismatching copies,
    the first vector, what later copies hold (excess) and what they would hold if all were like the first; with ``fallback``,
    a column that says whether a row's identity was made up from its tokens, also how many copies' were."""
    vector = F.array(*[F.col(f"n_{p}") for p in PATTERNS])
    made_up = F.coalesce(F.col(fallback), F.lit(False)) if fallback else F.lit(False)
    kinds = rows.select(identity, F.struct(*order).alias("at"), vector.alias("v"), made_up.alias("f")).groupBy(identity, "v").agg(F.count("*").alias("k"), F.min("at").alias("at"), F.count_if("f").alias("f"))
    cells = [F.sum(F.col("k") * F.get("v", F.lit(i))).alias(f"all_{p}") for i, p in enumerate(PATTERNS)]
    if fallback:
        cells.append(F.sum("f").alias("fallback_occurrences"))
    out = kinds.groupBy(identity).agg(F.sum("k").alias("occurrences"), F.min("at").alias("first_at"), F.min_by("v", "at").alias("first_vector"), F.count("*").alias("variants"), F.min_by("k", "at").alias("like_first"), *cells)
    out = out.where("occurrences > 1").withColumn("mismatches", F.col("occurrences") - F.col("like_first"))
    for i, p in enumerate(PATTERNS):
        first = F.get("first_vector", F.lit(i))
        out = out.withColumn(f"excess_{p}", F.col(f"all_{p}") - first).withColumn(f"nominal_{p}", (F.col("occurrences") - 1) * first)
    total = sum((F.col(f"excess_{p}") for p in PATTERNS), F.lit(0))
    return out.withColumn("excess", total).drop("like_first", *[f"all_{p}" for p in PATTERNS])


def variants(rows: DataFrame, identity: str, *order: str) -> DataFrame:
    """``(identity, vector, occurrences, retained)``: the distinct vectors of each repeating identity; the one of the
    first occurrence retains one copy."""
    vector = F.array(*[F.col(f"n_{p}") for p in PATTERNS])
    kinds = rows.select(identity, F.struct(*order).alias("at"), vector.alias("vector")).groupBy(identity, "vector").agg(F.count("*").alias("occurrences"), F.min("at").alias("at"))
    own = Window.partitionBy(identity)
    out = kinds.withColumn("all", F.sum("occurrences").over(own)).withColumn("first", F.min("at").over(own)).where("all > 1")
    return out.select(identity, "vector", "occurrences", F.when(F.col("at") == F.col("first"), 1).otherwise(0).cast("long").alias("retained"))


def variants_json(kinds: DataFrame, identity: str) -> DataFrame:
    """The variants of each identity as one JSON array: the first occurrence's first, the others by their vector as written."""
    names = F.array(*[F.lit(p) for p in PATTERNS])
    written = F.concat(F.lit("["), F.array_join("vector", ","), F.lit("]"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("retained")).alias("place"), written.alias("written"), "vector", "occurrences", "retained")))

    def item(x):
        excess = F.transform(x["vector"], lambda n: n * (x["occurrences"] - x["retained"]))
        return F.struct(
            x["occurrences"].alias("occurrences"), x["retained"].alias("retained_occurrences"),
            F.map_from_arrays(names, x["vector"]).alias("counts"), F.map_from_arrays(names, excess).alias("excess_counts"),
        )

    return kinds.groupBy(identity).agg(ordered.alias("_all")).select(identity, F.to_json(F.transform("_all", item)).alias("variants"))


def examples(rows: DataFrame, identity: str, index: str, fallback: str) -> DataFrame:
    """The export of repeated identities: one row each with its first sentence's ``index``, copies, fallbacks, whether all counts agree,
    its variants as JSON, and the first, excess and nominal counts with their totals."""
    found = audit(rows, identity, index, fallback=fallback)
    listed = variants_json(variants(rows, identity, index), identity).select(F.col(identity).alias("_i"), F.col("variants").alias("_json"))
    first = {p: F.get("first_vector", F.lit(i)) for i, p in enumerate(PATTERNS)}
    total = lambda columns: sum(columns, F.lit(0)).cast("long")
    joined = found.join(listed, F.col(identity).eqNullSafe(F.col("_i")))
    return joined.select(
        F.col(identity).alias("sentence_text"), F.col(f"first_at.{index}").alias("first_sentence_index"), "occurrences", "fallback_occurrences",
        F.when(F.col("mismatches") == 0, 1).otherwise(0).cast("long").alias("count_vectors_identical"), F.col("mismatches").alias("later_occurrences_with_different_counts"), F.col("_json").alias("pattern_count_variants_json"),
        total(first.values()).alias("first_total"), F.col("excess").cast("long").alias("excess_total"), total(F.col(f"nominal_{p}") for p in PATTERNS).alias("nominal_excess_total"),
        *[first[p].alias(f"first_{p}") for p in PATTERNS], *[f"excess_{p}" for p in PATTERNS], *[F.col(f"nominal_{p}").alias(f"nominal_excess_{p}") for p in PATTERNS],
    )


def rankings(audited: DataFrame, measures: tuple[str, ...], identity: str, most: int) -> DataFrame:
    """``(ranking, identity, value, place)``: the ``most`` identities of largest positive value by each measure, ties to the first
    occurrence. Each task keeps no more than that many of its rows."""
    out = None
    for m in measures:
        best = audited.where(F.col(m) > 0).orderBy(F.desc(m), "first_at").limit(most)
        place = F.row_number().over(Window.orderBy(F.desc(m), "first_at")).cast("long")
        ranked = best.select(F.lit(m).alias("ranking"), identity, F.col(m).cast("long").alias("value"), place.alias("place"))
        out = ranked if out is None else out.union(ranked)
    return out


def concentration(audited: DataFrame, *tops: int) -> DataFrame:
    """``(top, share)``: the share of all excess that the identities of most excess hold."""
    most = max(tops)
    total = audited.agg(F.sum("excess").alias("total"))
    best = audited.orderBy(F.desc("excess"), "first_at").limit(most).select("excess", "first_at")
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("excess"), "first_at")))
    held = ranked.agg(*[F.sum(F.when(F.col("place") <= t, F.col("excess"))).alias(f"t{t}") for t in tops])
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("top"), (F.col(f"t{t}") / F.col("total")).alias("share")) for t in tops])
    return held.crossJoin(total).select(F.inline(rows))  # one row by one row


#: How a claim's margin is named and what it needs beyond nought.
TOLERANCE = 1e-12


def highest(values: Column, target: Column) -> Column:
    """The margin by which ``target`` exceeds all of ``values`` (an array without it)."""
    return target - F.array_max(values)


def lowest(values: Column, target: Column) -> Column:
    return F.array_min(values) - target


def more_than_half(values: Column, target: Column) -> Column:
    """The number of ``values`` that ``target`` exceeds, less half of them."""
    return F.size(F.filter(values, lambda v: target > v)) - F.size(values) / 2


def beyond_range(values: Column, gap: Column) -> Column:
    """The margin by which a gap exceeds the range of ``values``."""
    return gap - (F.array_max(values) - F.array_min(values))


def verdict(margin_before, margin_after, tolerance: float = TOLERANCE):
    """STABLE while a claim's margin keeps its sign; a margin that vanishes is UNRESOLVED; absent: INCOMPLETE."""
    return (
        F.when(margin_before.isNull() | margin_after.isNull(), "INCOMPLETE")
        .when(margin_before <= tolerance, "UNRESOLVED")
        .when(margin_after <= tolerance, "NOT STABLE")
        .otherwise("STABLE")
    )


def overall(claims: DataFrame, *by: str) -> DataFrame:
    """``(by..., claims, unsupported, lost, verdict)`` of ``claims(before, after)``: INCOMPLETE if a margin is missing, else UNRESOLVED
    if one was none before, else NOT STABLE if one is lost, else STABLE."""
    v = verdict(F.col("before"), F.col("after"))
    n = lambda name: F.count_if(v == name)
    said = F.when(F.col("_i") > 0, "INCOMPLETE").when(F.col("unsupported") > 0, "UNRESOLVED").when(F.col("lost") > 0, "NOT STABLE").otherwise("STABLE")
    lost = F.count_if(F.col("after") <= TOLERANCE)
    return claims.groupBy(*by).agg(F.count("*").alias("claims"), n("INCOMPLETE").alias("_i"), n("UNRESOLVED").alias("unsupported"), lost.alias("lost")).select(*by, "claims", "unsupported", "lost", said.alias("verdict"))
