"""Columns that are derived once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def generated(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """``keys`` and new columns that come out of a generator: later steps read them as they are and don't derive them again.

    Projections are merged by the optimiser, and an array that a later lambda looks into would be
    made anew for each of its elements. The outer form, as a filter is put below the other one.
    """
    made = rows.select(*keys, F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made"))
    return made.select(*keys, "_made.*")
