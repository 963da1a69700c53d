"""Claims about groups as data: a catalogue compiled into one plan over a long table of measures and distances.

A claim names items, each a measure of a group (or its distance from an anchor) in a role, and a
kind says how the roles' order statistics make a margin. A margin above nought supports the claim.

======== ==================================================================
kind     margin
======== ==================================================================
above    least target less greatest other: highest, farthest set, direction
below    least other less greatest target: lowest, nearest set
positive least target: dominance by a measure that says by how much
majority others below the one target, less half of the others
closer   names whose target is below their other, less half of the names
range    target less other, less the range of the measures in role "among"
======== ==================================================================
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import PATTERNS
from .distributions import entropy, jensen_shannon, shares_of

KINDS = ("above", "below", "positive", "majority", "closer", "range")
_ITEMS = "array<struct<role:string,measure:string,anchor:string,name:string>>"
SCHEMA = f"label string, kind string, items {_ITEMS}"


@dataclass(frozen=True)
class Claim:
    label: str
    kind: str
    items: tuple[tuple[str, str, str, str], ...]  # role, measure, anchor ("" for none), name


def _items(role: str, measure: str, names: Iterable[str], anchor: str = "") -> tuple:
    return tuple((role, measure, anchor, n) for n in names)


def highest(label: str, measure: str, target: str, among: Iterable[str]) -> Claim:
    return Claim(label, "above", _items("target", measure, [target]) + _items("other", measure, [n for n in among if n != target]))


def lowest(label: str, measure: str, target: str, among: Iterable[str]) -> Claim:
    return Claim(label, "below", highest(label, measure, target, among).items)


def exceeds(label: str, measure: str, one: str, other: str) -> Claim:
    return highest(label, measure, one, [other])


def dominant(label: str, target: str) -> Claim:
    """The first order has more than twice what any other has."""
    return Claim(label, "positive", _items("target", "lead", [target]))


def above_majority(label: str, measure: str, target: str, among: Iterable[str]) -> Claim:
    return Claim(label, "majority", highest(label, measure, target, among).items)


def gap_beyond_range(label: str, measure: str, one: str, other: str, among: Iterable[str]) -> Claim:
    return Claim(label, "range", _items("target", measure, [one]) + _items("other", measure, [other]) + _items("among", measure, among))


def nearest(label: str, anchor: str, targets: Iterable[str], among: Iterable[str]) -> Claim:
    """No other is as near to ``anchor`` as the farthest of ``targets``."""
    targets = list(targets)
    return Claim(label, "below", _items("target", "distance", targets, anchor) + _items("other", "distance", [n for n in among if n not in (anchor, *targets)], anchor))


def farthest(label: str, anchor: str, targets: Iterable[str], among: Iterable[str]) -> Claim:
    return Claim(label, "above", nearest(label, anchor, targets, among).items)


def closer_to_majority(label: str, one: str, other: str, among: Iterable[str]) -> Claim:
    """``one`` is nearer than ``other`` to more than half of the rest."""
    rest = [n for n in among if n not in (one, other)]
    return Claim(label, "closer", _items("target", "distance", rest, one) + _items("other", "distance", rest, other))


def catalogue(spark: SparkSession, claims: Iterable[Claim]) -> DataFrame:
    return spark.createDataFrame([(c.label, c.kind, [*c.items]) for c in claims], SCHEMA)


def measures(vectors: DataFrame, name: str, states: tuple[str, ...] = ("before", "after")) -> DataFrame:
    """``(state, measure, anchor, name, value)`` of vectors of six counts, an array column for each state.

    Measures are each order's share, entropy, and lead: the first order less twice the largest
    other. Distances (Jensen-Shannon) run both ways between any two groups; an empty vector has none.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    out = None
    for state in states:
        v = F.col(state).cast("array<double>")
        rows = vectors.where(total(v) > 0).select(F.col(name).alias("name"), v.alias("v"), shares_of(v).alias("p"))
        facts = [F.struct(F.lit(f"share_{o}").alias("measure"), F.get("p", F.lit(i)).alias("value")) for i, o in enumerate(PATTERNS)]
        facts.append(F.struct(F.lit("entropy").alias("measure"), entropy(F.col("p")).alias("value")))
        facts.append(F.struct(F.lit("lead").alias("measure"), (F.get("v", F.lit(0)) - 2 * F.array_max(F.slice("v", 2, len(PATTERNS) - 1))).alias("value")))
        own = rows.select("name", F.inline(F.array(*facts))).select(F.lit(state).alias("state"), "measure", F.lit("").alias("anchor"), "name", "value")
        gathered = rows.agg(F.collect_list(F.struct("name", "p")).alias("all"))  # groups are corpora, tens of them
        two = gathered.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.name <> b.name")
        far = two.select(F.lit(state), F.lit("distance"), "a.name", "b.name", jensen_shannon(F.col("a.p"), F.col("b.p")))
        out = own.union(far) if out is None else out.union(own).union(far)
    return out


def nearest_sets(long: DataFrame, k: int, state: str = "before") -> DataFrame:
    """A catalogue that the data make: for each anchor, the ``k`` nearest and the ``k`` farthest groups as they are in ``state``, ties by name."""
    listed = F.sort_array(F.collect_list(F.struct("value", "name")))
    rows = long.where((F.col("measure") == "distance") & (F.col("state") == state)).groupBy("anchor").agg(listed.alias("by"))
    near, far = F.slice("by", 1, k), F.when(F.size("by") > k, F.slice("by", -k, k)).otherwise(F.col("by"))

    def claim(kind: str, label: str, chosen: Column) -> DataFrame:
        names = F.transform(chosen, lambda x: x["name"])
        item = lambda x: F.struct(F.when(F.array_contains(names, x["name"]), "target").otherwise("other").alias("role"), F.lit("distance").alias("measure"), F.col("anchor"), x["name"].alias("name"))
        said = F.concat(F.col("anchor"), F.lit(f": {label} "), F.array_join(F.array_sort(names), ", "))
        return rows.where(F.size("by") > k).select(said.alias("label"), F.lit(kind).alias("kind"), F.transform("by", item).cast(_ITEMS).alias("items"))

    return claim("below", "nearest", near).union(claim("above", "farthest", far))


def margins(claims: DataFrame, long: DataFrame, states: tuple[str, ...] = ("before", "after")) -> DataFrame:
    """``(label, kind, state, margin)`` of every claim in every state; null where any of its items has no value.

    One join and two aggregations, whatever kinds there are; a claim's items are one group.
    """
    each = claims.select("label", "kind", F.explode("items").alias("i"), F.array(*[F.lit(s) for s in states]).alias("states")).select("label", "kind", "i.*", F.explode("states").alias("state"))
    found = each.join(long, ["state", "measure", "anchor", "name"], "left")
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("value")))
    named = found.groupBy("label", "kind", "state", "name").agg(role("target").alias("t"), role("other").alias("o"), role("among").alias("m"), F.count_if(F.col("value").isNull()).alias("absent"))
    stat = named.groupBy("label", "kind", "state").agg(
        F.min("t").alias("t_least"), F.max("t").alias("t_most"), F.min("o").alias("o_least"), F.max("o").alias("o_most"), F.min("m").alias("m_least"), F.max("m").alias("m_most"),
        F.collect_list("o").alias("others"), F.count_if(F.col("t") < F.col("o")).alias("nearer"), F.count("*").alias("names"), F.sum("absent").alias("absent"),
    )
    margin = (
        F.when(F.col("kind") == "above", F.col("t_least") - F.col("o_most"))
        .when(F.col("kind") == "below", F.col("o_least") - F.col("t_most"))
        .when(F.col("kind") == "positive", F.col("t_least"))
        .when(F.col("kind") == "majority", F.size(F.filter("others", lambda x: x < F.col("t_least"))) - F.size("others") / 2)
        .when(F.col("kind") == "closer", F.col("nearer") - F.col("names") / 2)
        .when(F.col("kind") == "range", F.col("t_least") - F.col("o_most") - (F.col("m_most") - F.col("m_least")))
    )
    return stat.select("label", "kind", "state", F.when(F.col("absent") == 0, margin).alias("margin"))


def judged(claims: DataFrame, long: DataFrame) -> DataFrame:
    """``(label, kind, before, after)``: the margins of both states side by side, for ``repetition.verdict`` and ``overall``."""
    at = lambda s: F.max(F.when(F.col("state") == s, F.col("margin"))).alias(s)
    return margins(claims, long).groupBy("label", "kind").agg(at("before"), at("after"))
