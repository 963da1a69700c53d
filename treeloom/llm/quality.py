"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Only DataFrame expressions run here. Every text gives a few integer counts; their rates are
binned into sketches of fixed relative precision whose bins add up (so partial, per-source,
per-language and global sketches are sums of one another and any order of merging gives the
same numbers). Quartiles read from the sketches set the fences of each language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import WHITE, stage, text_or_empty

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: rate -> (numerator, scale of n_words, slack beyond the fence, judged on the low side too)
RATES = {
    "r_symbols": ("n_symbols", 1000, 100, False),
    "r_dup_lines": ("n_dup_lines", 1000, 30, False),
    "r_repeat": ("n_repeat_words", 1000, 300, False),
    "r_chars": ("word_chars", 100, 100, True),
}
#: Interquartile ranges between a quartile and its fence.
FENCE = 3
#: A sketch of fewer documents gives way to the next wider one.
LEAST_DOCS = 30
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(docs: DataFrame) -> DataFrame:
    """Adds the five counts of the contract and ``base_failed`` to ``docs``; null texts have no words.

    Repeated 3-word windows are found inside the row: window hashes, each with its position in
    the low bits, are sorted, and neighbours of one hash are compared word by word.
    """
    kept = [c for c in docs.columns if c not in {*FEATURES, "base_failed"}]
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(WHITE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = docs.select(
        *kept,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT)).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    bits = F.length(F.bin(F.size("_words"))).cast("int")
    df = df.withColumn("_bits", bits).withColumn("_n", F.size("_words"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("_sorted", F.when(F.col("_n") >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<bigint>")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(F.col("_mask")).cast("int"), y.bitwiseAND(F.col("_mask")).cast("int")
        alike = F.call_function("shiftright", x, F.col("_bits")) == F.call_function("shiftright", y, F.col("_bits"))
        for k in (0, 1, 2):
            alike = alike & (F.get("_words", p + k) == F.get("_words", q + k))
        return F.coalesce(alike, F.lit(False))

    df = df.withColumn("_mask", mask)
    repeated = F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(F.col("_mask")).cast("int"))))
    covered = F.aggregate(
        F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    df = df.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rates(df: DataFrame) -> DataFrame:
    """Adds the integer rates that the fences judge; documents without words have none."""
    for name, (count, scale, _, _) in RATES.items():
        df = df.withColumn(name, F.when(F.col("n_words") > 0, F.expr(f"{scale} * {count} div n_words")))
    return df


def sketch_bin(value: Column) -> Column:
    """Values below 256 as they are; above, the leading eight bits (relative error under 1/128)."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 8).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(df: DataFrame) -> DataFrame:
    """The mergeable sketches: ``(lang, source, rate, bin, n)`` over documents that pass the base rules."""
    long = rates(df).where("not base_failed").select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), sketch_bin(F.col(r)).alias("bin")) for r in RATES])).alias("x")
    )
    return long.groupBy("lang", "source", "x.rate", "x.bin").agg(F.count("*").alias("n"))


def _quartiles(bins: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """The lower and upper quartile of each sketch: the first bin at which the running count reaches n/4, 3n/4."""
    bins = bins.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "rate")
    bins = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    return bins.groupBy(*keys, "rate").agg(
        F.max("all").alias(f"docs{suffix}"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias(f"lower{suffix}"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias(f"upper{suffix}"),
    )


def thresholds(df: DataFrame) -> DataFrame:
    """``(lang, source, <rate>_low, <rate>_high ...)`` for each language and source that occurs.

    The narrowest sketch with LEAST_DOCS documents speaks: language and source, language, all.
    The global sketch speaks for any number of documents; if no document passes the base rules
    there is no fence.
    """
    made = stage(sketches(df), "sketches").df
    groups = df.select("lang", "source").distinct()
    rate_names = F.explode(F.array(*[F.lit(r) for r in RATES])).alias("rate")
    grid = groups.select("lang", "source", rate_names)
    fine, mid = _quartiles(made, ["lang", "source"], "_fine"), _quartiles(made, ["lang"], "_mid")
    wide = _quartiles(made, [], "_wide")
    fine = fine.withColumnsRenamed({"lang": "l", "source": "s", "rate": "r"})
    mid = mid.withColumnsRenamed({"lang": "l", "rate": "r"})
    joined = (
        grid.join(fine, F.col("lang").eqNullSafe(fine.l) & F.col("source").eqNullSafe(fine.s) & (F.col("rate") == fine.r), "left")
        .drop("l", "s", "r")
        .join(mid, F.col("lang").eqNullSafe(mid.l) & (F.col("rate") == mid.r), "left")
        .drop("l", "r")
        .join(wide, "rate", "left")
    )

    def pick(name: str) -> Column:
        return F.when(F.col("docs_fine") >= LEAST_DOCS, F.col(f"{name}_fine")).when(F.col("docs_mid") >= LEAST_DOCS, F.col(f"{name}_mid")).otherwise(F.col(f"{name}_wide"))

    spread = joined.select("lang", "source", "rate", pick("lower").alias("q1"), pick("upper").alias("q3"))
    columns = []
    for r, (_, _, slack, low_too) in RATES.items():
        reach = FENCE * (F.col("q3") - F.col("q1")) + slack
        columns.append(F.max(F.when(F.col("rate") == r, F.col("q3") + reach)).alias(f"{r}_high"))
        if low_too:
            columns.append(F.max(F.when(F.col("rate") == r, F.col("q1") - reach)).alias(f"{r}_low"))
    return spread.groupBy("lang", "source").agg(*columns)


def verdicts(features: DataFrame, fences: DataFrame) -> DataFrame:
    """``features`` with ``kept``: passes the base rules and lies within the fences of its language and source."""
    f = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    df = rates(features).join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    ok = ~F.col("base_failed")
    for r, (_, _, _, low_too) in RATES.items():
        ok = ok & F.coalesce(F.col(r) <= F.col(f"{r}_high"), F.lit(True))
        if low_too:
            ok = ok & F.coalesce(F.col(r) >= F.col(f"{r}_low"), F.lit(True))
    return df.withColumn("kept", ok).select(*features.columns, "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, ``base_failed`` and ``kept``.

    Null texts and texts of white space have no words and fail the base rules. Null languages
    and sources form groups of their own. Repeated rows are judged alike. Other columns of
    ``docs`` are ignored, also where they bear names used here.
    """
    made = stage(with_features(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality").df
    fences = stage(thresholds(made), "fences").df
    return verdicts(made, fences).select("doc_id", *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they came, that ``quality_rules`` keeps.

    Rows are staged once beside their counts; fences and filter work on that table, so no text
    is counted twice or shuffled.
    """
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "source", "text")
    made = stage(with_features(nested).drop("text"), "quality").df
    fences = stage(thresholds(made.drop("row")), "fences").df
    return verdicts(made, fences).where("kept").select("row.*")
