"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is every document's expected number of copies; the whole
part is taken as it is, the fraction is an inclusion probability. The flight phase moves these
probabilities through the null space of two constraints (words and documents) until each is 0
or 1, so both totals stay where they were. Each move is the projection on that space of the
largest undecided document, so all the others make up for it by a little and the smallest are
left to the end. Blocks of a source fly apart; what they leave undecided (two documents each at
most) flies again in fewer blocks, until KEEP documents a source remain for the landing: of the
outcomes that miss the words by little one is drawn, with odds that keep every document's chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a source may be repeated.
SHARE, MOST = 1.5, 2.0
BLOCK = 4096
#: Documents that land at a time (two to that power of outcomes are weighed), and by which share of their words an outcome may
#: miss: the least that leaves outcomes enough to keep all chances, or else FAR.
KEEP, OFF, FAR = 12, (0.005, 0.01, 0.02), 0.01
_ZERO = 1e-9


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, source, size, key, keep...)`` of ``docs(doc_id, source, text)``: its words, and a hash of what tells it from others."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key"), *keep)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, n, source_size, target)``: the share split by weight, no target above ``most`` times its size.

    Sources weigh by place in code point order, null last. Resharing the excess by weight until
    none is above its limit ends where target = min(level * weight, limit) for one level; the
    level is read from running sums in the order in which limits are met.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    df = by_source.withColumn("w", w).withColumn("limit", most * F.col("source_size"))
    everything = Window.partitionBy()
    met = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before = met.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "left": share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
            "turn": F.row_number().over(met),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("turn", "level"))).over(everything)["level"]
    target = F.coalesce(F.least(level * F.col("w"), F.col("limit")), F.col("limit"))
    return df.select("source", "n", "source_size", target.cast("double").alias("target"))


def _draw(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest()) / 2**64


def fly(size, chance, seed, stop: int = 2) -> np.ndarray:
    """Moves chances until ``stop`` (two or more) at most lie strictly between 0 and 1; keeps the sums of chance and of size * chance.

    ``size`` descends. Each move goes along the projection of the first open document on the null
    space of both sums (of the next one, where the first can't move), up or down with the odds
    that keep every document's expected chance as it is, until one document or more is decided.
    """
    chance, size = np.array(chance, float), np.asarray(size, float)
    rng = np.random.default_rng(int(_draw(seed) * 2**63))
    _settled(chance)
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    while len(open_) > stop:
        c, s = chance[open_], size[open_]
        step = _direction(s - s.mean())
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(step > 0, (1 - c) / step, np.where(step < 0, -c / step, np.inf)).min()
            down = np.where(step > 0, c / step, np.where(step < 0, (c - 1) / step, np.inf)).min()
        c += step * (up if rng.random() * (up + down) < down else -down)
        _settled(c)
        chance[open_] = c
        open_ = open_[(c > 0) & (c < 1)]
    return chance


def _direction(off: np.ndarray) -> np.ndarray:
    """The projection of the first unit vector that has one on what is orthogonal to ones and to ``off``, which sums to nought."""
    n, square = len(off), float(off @ off)
    even = square <= 1e-9
    for i in range(n):
        step = np.full(n, -1 / n) if even else -1 / n - off * (off[i] / square)
        step[i] += 1
        if step[i] > 1e-9:
            step[np.abs(step) < 1e-13] = 0
            return step
    raise AssertionError("three numbers can't all be fixed by two sums")


def _settled(chance: np.ndarray) -> None:
    chance[chance < _ZERO] = 0
    chance[chance > 1 - _ZERO] = 1


def land(size, chance, seed) -> np.ndarray:
    """Decides the KEEP documents at most that are open: one of the outcomes that miss their words by little, each document with its own chance.

    Where no odds of such outcomes keep all chances, as with a document of a good part of all
    words, the words go first and the odds are those that come nearest to the chances.
    """
    size, chance = np.asarray(size, float), np.array(chance, float)
    _settled(chance)
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(open_):
        return chance
    c, s = chance[open_], size[open_]
    every = (np.arange(2 ** len(c))[:, None] >> np.arange(len(c)) & 1).astype(float)
    miss = np.abs(every @ s - c @ s)
    for off in (*OFF, FAR):
        near = every[miss <= max(off * s.sum(), float(miss.min()) + _ZERO)]
        odds, wrong = _odds(near, c)
        if wrong < 1e-4:
            break
    at = int(np.searchsorted(np.cumsum(odds) / odds.sum(), _draw(seed), side="right"))
    chance[open_] = near[min(at, len(near) - 1)]
    return chance


def _odds(outcomes: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, float]:
    """The most even odds of outcomes under which each document's chance is as given, and by how much they miss that: Newton's method on the tilt."""
    tilt = np.log(chance / (1 - chance))

    def tilted(t: np.ndarray) -> tuple[np.ndarray, float]:
        power = outcomes @ t
        weight = np.exp(power - power.max())
        return weight / weight.sum(), float(t @ chance - power.max() - np.log(weight.sum()))

    odds, height = tilted(tilt)
    for _ in range(60):
        off = chance - odds @ outcomes
        if np.abs(off).max() < 1e-9:
            break
        spread = (outcomes * odds[:, None]).T @ outcomes - np.outer(odds @ outcomes, odds @ outcomes)
        step, part = np.linalg.solve(spread + 1e-9 * np.eye(len(chance)), off), 1.0
        while part > 1e-6:
            new, higher = tilted(tilt + part * step)
            if higher > height:
                break
            part /= 2
        else:
            break
        tilt, odds, height = tilt + part * step, new, higher
    return odds, float(np.abs(chance - odds @ outcomes).max())


def _round(units: DataFrame, landing: bool, turn: int, seed: int, schema) -> DataFrame:
    """One flight of every block of ``units(source, size, key, chance, block, ...)``."""

    def run(key, block):
        source, number = (k.as_py() for k in key)
        keys, size, chance = (block[k].to_numpy() for k in ("key", "size", "chance"))
        turns = _mixed(keys.view(np.uint64) ^ np.uint64(int(_draw(seed, turn) * 2**63)))
        order = np.lexsort((chance, turns, -size))
        flown = fly(size[order], chance[order], (seed, turn, source, number), KEEP if landing else 2)
        if landing:
            flown = land(size[order], flown, (seed, "land", source))
        block = block.take(pa.array(order)).drop_columns(["block"])
        return block.set_column(block.column_names.index("chance"), "chance", pa.array(flown))

    return units.groupBy("source", "block").applyInArrow(run, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _decide(sized: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """``sized`` with ``whole`` and ``chance``, now 0 or 1, of each row."""
    own = goal.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", rate)
    units = stage(units.select(*sized.columns, F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance")), "mix-units").df
    is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
    decided, rest, turn = [units.where(~is_open)], units.where(is_open), 0
    while True:
        counts = rest.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        most = counts.agg(F.max("_blocks")).first()[0]
        if most is None:
            break
        cut = rest.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        cut = cut.withColumn("block", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("_blocks"))).drop("_blocks")
        flown = stage(_round(cut, most == 1, turn, seed, units.schema), "mix-round").df
        decided.append(flown.where(~is_open))
        if most == 1:
            break
        rest, turn = flown.where(is_open), turn + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out


def mix(docs: DataFrame, seed: int = 11, **kind) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, source, size, source_size, target, copies, taken.

    Null texts and texts without words have size 0 and take 0 words (and no copy); null sources
    form a source of their own, weighed last; rows that repeat a doc_id are documents of their
    own, and so are rows without one. An empty table gives an empty result. The same table
    gives the same mix, however it is partitioned.
    """
    sized = stage(sizes(docs), "mix-sizes").df
    goal = stage(targets(sized, **kind), "mix-targets").df
    copies = F.col("whole") + F.col("chance").cast("long")
    own = goal.withColumnRenamed("source", "_source")
    out = _decide(sized, goal, seed).join(own, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix itself: each row of ``docs``, columns as they came, as often as ``mix`` takes it.

    Rows are staged once with a number, and each decision goes back to the row it was made for,
    whatever ids or texts repeat. Rows of no words are taken no time; so is all of an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stage(sizes(docs.select("doc_id", "source", "text", row), "row").select("*", F.monotonically_increasing_id().alias("rid")), "mix-rows").df
    sized = rows.select("source", "size", "key", "rid")
    goal = stage(targets(sized), "mix-targets").df
    taken = _decide(sized, goal, seed).select(F.col("rid").alias("_rid"), (F.col("whole") + F.col("chance").cast("int")).cast("int").alias("_n")).where("_n > 0")
    joined = rows.select("rid", "row").join(taken, F.col("rid") == F.col("_rid"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("row.*")
