"""Names and types that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: The six orders, in canonical (not alphabetical) order.
PATTERNS = ("SVO", "SOV", "VSO", "VOS", "OSV", "OVS")

TOKEN = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("form", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("upos", T.StringType()),
        T.StructField("xpos", T.StringType()),
        T.StructField("feats", T.StringType()),
        T.StructField("head", T.IntegerType()),
        T.StructField("deprel", T.StringType()),
        T.StructField("deps", T.StringType()),
        T.StructField("misc", T.StringType()),
    ]
)


def pattern_rank(pattern: Column) -> Column:
    """1..6 in canonical order; 0 for anything else."""
    return F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), pattern)
