"""Counts before and after removing repeats, kept up to date over a stream that may bring copies in any order.

The state of an identity is its copy of least order and that copy's counts. A batch's changes come
out as sums to be added to both totals; a copy that is earlier than the one kept takes its place,
and the change says so, so the sum of all changes equals the batch query whatever came when.

``states`` keeps the same state by an aggregation of Spark's own, without Python for each
identity: what comes out are the states that a batch touched, of which the last ones count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.repetition import digest
from ..schema import PATTERNS

_BEFORE, _AFTER = [f"before_{p}" for p in PATTERNS], [f"after_{p}" for p in PATTERNS]
CHANGES = "scope string, sentences long, kept long, " + ", ".join(f"{c} long" for c in (*_BEFORE, *_AFTER))


class FirstSeen(StatefulProcessor):
    """One value an identity: the order and the counts of the first copy by order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "major long, minor long, " + ", ".join(f"n_{p} long" for p in PATTERNS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, before, best = 0, [0] * len(PATTERNS), None
        for frame in rows:
            counts = frame[[f"n_{p}" for p in PATTERNS]]
            seen, before = seen + len(frame), [a + int(b) for a, b in zip(before, counts.sum(), strict=True)]
            least = tuple(int(x) for x in min(frame[["major", "minor", *counts.columns]].itertuples(index=False, name=None)))
            best = least if best is None else min(best, least)
        kept = tuple(self.first.get()) if self.first.exists() else None
        after = [0] * len(PATTERNS)
        if best is not None and (kept is None or best < kept):
            after = [n - (kept[i + 2] if kept else 0) for i, n in enumerate(best[2:])]
            self.first.update(best)
        if seen:
            yield pd.DataFrame([[key[0], seen, int(kept is None), *before, *after]], columns=["scope", "sentences", "kept", *_BEFORE, *_AFTER])

    def close(self) -> None:
        pass


def changes(rows: DataFrame, scope: str, identity: str, major: str, minor: str) -> DataFrame:
    """A stream of changes (CHANGES) from a stream of rows with six counts ``n_*`` and an order of two whole numbers.

    The key is the scope with the identity's digest, so texts are no part of the state, which
    lives in RocksDB (``counts.on_disk_state``) and has a row for each identity ever seen. Null
    scopes and identities are values. One row a key and batch is what comes out.
    """
    return _keyed(rows, scope, identity, major, minor).groupBy("scope", "id").transformWithStateInPandas(FirstSeen(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def _keyed(rows: DataFrame, scope: str, identity: str, major: str, minor: str) -> DataFrame:
    return rows.select(F.col(scope).alias("scope"), digest(F.col(identity)).alias("id"), F.col(major).cast("long").alias("major"), F.col(minor).cast("long").alias("minor"), *[F.col(f"n_{p}").cast("long").alias(f"n_{p}") for p in PATTERNS])


STATES = "scope string, id binary, sentences long, " + ", ".join(f"{c} long" for c in (*_BEFORE, *_AFTER))


def states(rows: DataFrame, scope: str, identity: str, major: str, minor: str) -> DataFrame:
    """A stream of states (STATES) from rows as ``changes`` takes them, for the update mode and ``appended``."""
    first = F.min(F.struct("major", "minor", *[f"n_{p}" for p in PATTERNS])).alias("first")
    made = _keyed(rows, scope, identity, major, minor).groupBy("scope", "id").agg(F.count("*").alias("sentences"), *[F.sum(f"n_{p}").alias(f"before_{p}") for p in PATTERNS], first)
    return made.select("scope", "id", "sentences", *_BEFORE, *[F.col(f"first.n_{p}").alias(f"after_{p}") for p in PATTERNS])


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's rows in a folder of its own, written anew if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def state_totals(states_: DataFrame) -> DataFrame:
    """``totals`` from all states that came out: an identity's last one has seen the most sentences."""
    last = states_.groupBy("scope", "id").agg(F.max(F.struct("sentences", *_BEFORE, *_AFTER)).alias("last")).select("scope", "last.*", F.lit(1).cast("long").alias("kept"))
    return totals(last)


def totals(changes_: DataFrame) -> DataFrame:
    """``(scope, sentences, kept, before_*, after_*)``: the sums of all changes so far."""
    return changes_.groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("sentences", "kept", *_BEFORE, *_AFTER)])
