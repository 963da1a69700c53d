"""Data contracts as queries: each returns the rows that break a rule, none if all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import PATTERNS
from ..sources.scratch import staged

TOLERANCE = 5.1e-7


def distribution_violations(rows: DataFrame, group: str, tolerance: Column | None = None) -> DataFrame:
    """``(group, rule)`` for six-row distributions ``(group, pattern, n, total, proportion)``; proportions may be out by ``tolerance``."""
    most = F.lit(TOLERANCE) if tolerance is None else tolerance
    each = rows.groupBy(group).agg(
        F.count_if(F.col("n") < 0).alias("negative"),
        F.count_if(F.col("total") <= 0).alias("empty"),
        F.count_if(F.abs(F.col("proportion") - F.col("n") / F.col("total")) > most).alias("proportion"),
        F.sort_array(F.collect_list("pattern")).alias("patterns"),
        F.count_distinct("total").alias("totals"),
        F.sum("n").alias("sum"),
        F.max("total").alias("total"),
    )
    rules = {
        "negative": F.col("negative") > 0,
        "empty": F.col("empty") > 0,
        "proportion": F.col("proportion") > 0,
        "patterns": F.col("patterns") != F.array(*[F.lit(p) for p in sorted(PATTERNS)]),
        "totals": F.col("totals") > 1,
        "sum": F.col("sum") != F.col("total"),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return each.select(group, F.explode(broken).alias("rule"))


def grid_violations(rows: DataFrame, expected: DataFrame, place: str | None = None) -> DataFrame:
    """Keys missing from, foreign to or repeated in ``rows`` against the ``expected`` grid.

    With ``place``, a column of both that numbers rows in their order, also keys that don't follow
    the key that the grid has before them: each row is held against the grid's at its place.
    """
    keys = [c for c in expected.columns if c != place]
    have, want = rows.select(*keys), expected.select(*keys)
    found = (
        want.exceptAll(have.distinct()).withColumn("rule", F.lit("missing"))
        .union(have.distinct().exceptAll(want).withColumn("rule", F.lit("foreign")))
        .union(have.groupBy(*keys).count().where("count > 1").drop("count").withColumn("rule", F.lit("repeated")))
    )
    if place is None:
        return found
    at = expected.select(F.col(place).alias("_place"), F.struct(*keys).alias("_want"))
    placed = rows.select(F.col(place).alias("_at"), F.struct(*keys).alias("_have")).join(at, F.col("_at") == F.col("_place"), "left")
    return found.union(placed.where(~F.col("_have").eqNullSafe(F.col("_want"))).select("_have.*", F.lit("order")))


def structure_violations(before: DataFrame, after: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Positions at which two tables differ in ``columns``, or that only one has."""
    a, b = (x.select(*key, F.struct(*columns).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def digest(items: str, fields: list[str]) -> Column:
    """96 bits of hash over ``fields`` of the structs in the array ``items``, in order; null reads as the character NUL."""
    said = F.transform(items, lambda t: F.struct(*[F.coalesce(t[c].cast("string"), F.lit("\0")).alias(c) for c in fields]))
    return F.struct(F.xxhash64(said, F.size(items)).alias("a"), F.hash(said).alias("b"))


def differing(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """``key`` of the rows that the two tables don't have alike: a key with a digest that one of them has more often. Staged.

    What is shuffled is a key and a digest a row.
    """
    sides = before.select(key, digest, F.lit(1).alias("_n")).union(after.select(key, digest, F.lit(-1).alias("_n")))
    return staged(sides.groupBy(key, digest).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(key).distinct(), "differing")


def repetition_violations(audited: DataFrame, variants: DataFrame, identity: str) -> DataFrame:
    """Identities whose variants don't add up to their occurrences or retain other than one copy."""
    v = variants.groupBy(F.col(identity).alias("_i")).agg(F.sum("occurrences").alias("seen"), F.sum("retained").alias("kept"))
    j = audited.join(v, F.col(identity).eqNullSafe(F.col("_i")), "full_outer")
    return j.where(~(F.col("seen").eqNullSafe(F.col("occurrences")) & F.col("kept").eqNullSafe(F.lit(1))))


def digest_violations(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """``(name, expected, sha256)`` of files whose digest isn't the one pinned for their name, or that are missing; unpinned ones pass."""
    want = pinned.where("expected is not null and expected <> ''").select("name", "expected")
    return want.join(found.select("name", "sha256"), "name", "left").where(~F.col("expected").eqNullSafe(F.col("sha256")))


def profile_violations(profiles: DataFrame, expected: DataFrame) -> DataFrame:
    """``(name, rule)`` of prepared corpora that break ``expected(name, sentences, ner)``: blocks, at least one token, NER where needed."""
    j = expected.join(profiles, "name", "left")
    rules = {
        "missing": F.col("blocks").isNull(),
        "sentences": F.col("sentences").isNotNull() & (F.col("blocks") != F.col("sentences")),
        "no tokens": F.col("tokens") == 0,
        "no NER tags": F.col("ner") & (F.col("ner_tokens") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return j.select("name", F.explode(broken).alias("rule"))


def checked(checks: DataFrame) -> DataFrame:
    """One row ``(checks, failed, labels)`` of ``checks(label, ok)``: how many were made and which failed (null counts as failed)."""
    bad = ~F.coalesce("ok", F.lit(False))
    return checks.agg(F.count("*").alias("checks"), F.count_if(bad).alias("failed"), F.sort_array(F.collect_list(F.when(bad, F.col("label")))).alias("labels"))
