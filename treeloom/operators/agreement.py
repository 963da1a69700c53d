"""Agreement of two annotations of the same sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import PATTERNS

KEYS = ["doc_id", "line_no", "v"]
KINDS = ("same", "changed", "unclear", "gold_only", "auto_only")
_RECORD = "kind:string,gold:string,auto:string,n_gold:bigint,n_auto:bigint,s:int,o:int"


def align(gold: DataFrame, auto: DataFrame) -> DataFrame:
    """Aligns instances ``(doc_id, line_no, s, v, o, pattern)`` of two annotations.

    One row for each record: doc_id, line_no, v, kind, gold and auto pattern, n_gold and n_auto
    (instances in it), and s and o of a one-sided one. A verb's instances meet in one row, and
    each stage works on what those before left: the same three tokens (``same``); subject and
    object exchanged (``changed``); two that share an argument with one another and with nothing
    else (``unclear``, a record each); what still shares one (one ``unclear`` record for the
    verb); the rest is in one annotation alone. Instances of a verb differ in subject or object.
    """
    cell = F.struct(F.col("s").cast("int").alias("s"), F.col("o").cast("int").alias("o"), "pattern")
    both = gold.select(*KEYS, cell.alias("g"), F.lit(None).alias("a")).union(auto.select(*KEYS, F.lit(None), cell.alias("a")))
    df = both.groupBy(*KEYS).agg(F.collect_list("g").alias("g"), F.collect_list("a").alias("a"))
    alike = lambda x, y: (x["s"] == y["s"]) & (x["o"] == y["o"])
    turned = lambda x, y: (x["s"] == y["o"]) & (x["o"] == y["s"])
    touching = lambda x, y: (x["s"] == y["s"]) | (x["o"] == y["o"]) | (x["s"] == y["o"]) | (x["o"] == y["s"])
    having = lambda of, test, n=None: lambda x: (F.exists(of, lambda y: test(x, y)) if n is None else F.size(F.filter(of, lambda y: test(x, y))) == n)
    without = lambda of, test: lambda x: ~F.exists(of, lambda y: test(x, y))
    first = lambda of, test, x: F.get(F.filter(of, lambda y: test(x, y)), F.lit(0))

    def record(kind: str, gold: Column | None, auto: Column | None, n_gold: Column | int, n_auto: Column | int, of: Column | None = None) -> Column:
        text = lambda x: F.lit(None).cast("string") if x is None else x
        number = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
        at = lambda k: F.lit(None).cast("int") if of is None else of[k]
        return F.struct(F.lit(kind).alias("kind"), text(gold).alias("gold"), text(auto).alias("auto"), number(n_gold).alias("n_gold"), number(n_auto).alias("n_auto"), at("s").alias("s"), at("o").alias("o"))

    df = df.select(*KEYS, "g", "a", F.filter("g", without("a", alike)).alias("g1"), F.filter("a", without("g", alike)).alias("a1"))
    df = df.select("*", F.filter("g1", without("a1", turned)).alias("g2"), F.filter("a1", without("g1", turned)).alias("a2"))
    df = df.select("*", F.filter("g2", having("a2", touching)).alias("gn"), F.filter("a2", having("g2", touching)).alias("an"))
    alone = lambda x: having("an", touching, 1)(x) & having("gn", touching, 1)(first("an", touching, x))
    df = df.select("*", F.filter("gn", alone).alias("gp"))
    left = F.size("gn") - F.size("gp")
    lone = lambda c, n: F.when(n == 1, F.get(F.filter(c, lambda x: ~F.exists("gp", lambda y: touching(x, y))), F.lit(0))["pattern"])
    n_left = F.size("an") - F.size("gp")
    none = F.array().cast(f"array<struct<{_RECORD}>>")
    found = F.concat(
        F.transform(F.filter("g", having("a", alike)), lambda x: record("same", x["pattern"], first("a", alike, x)["pattern"], 1, 1)),
        F.transform(F.filter("g1", having("a1", turned)), lambda x: record("changed", x["pattern"], first("a1", turned, x)["pattern"], 1, 1)),
        F.transform("gp", lambda x: record("unclear", x["pattern"], first("an", touching, x)["pattern"], 1, 1)),
        F.when(left > 0, F.array(record("unclear", lone("gn", left), lone("an", n_left), left, n_left))).otherwise(none),
        F.transform(F.filter("g2", without("a2", touching)), lambda x: record("gold_only", x["pattern"], None, 1, 0, x)),
        F.transform(F.filter("a2", without("g2", touching)), lambda x: record("auto_only", None, x["pattern"], 0, 1, x)),
    )
    return df.select(*KEYS, F.explode_outer(found).alias("r")).where("r is not null").select(*KEYS, "r.*")


def matrix(aligned: DataFrame) -> DataFrame:
    """``(gold, auto, n)`` of the aligned instances."""
    return aligned.where("kind in ('same', 'changed')").groupBy("gold", "auto").agg(F.count("*").alias("n"))


def margins(cells: DataFrame, gold: DataFrame, auto: DataFrame) -> DataFrame:
    """For each pattern of the matrix ``cells``: its margins, how much is off the diagonal, and whether the margins stay
    within the counts ``(pattern, n)`` of either annotation."""
    rows = F.array(
        F.struct(F.col("gold").alias("pattern"), F.col("n").alias("gold_aligned"), F.lit(0).cast("long").alias("auto_aligned"), F.when(F.col("gold") == F.col("auto"), F.col("n")).otherwise(0).cast("long").alias("diagonal")),
        F.struct(F.col("auto").alias("pattern"), F.lit(0).cast("long").alias("gold_aligned"), F.col("n").alias("auto_aligned"), F.lit(0).cast("long").alias("diagonal")),
    )
    sums = cells.select(F.inline(rows)).groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("gold_aligned", "auto_aligned", "diagonal")])
    names = cells.sparkSession.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    all_ = names.join(gold.withColumnRenamed("n", "gold_n"), "pattern", "left").join(auto.withColumnRenamed("n", "auto_n"), "pattern", "left").join(sums, "pattern", "left").fillna(0)
    within = (F.col("gold_aligned") <= F.col("gold_n")) & (F.col("auto_aligned") <= F.col("auto_n"))
    return all_.select("pattern", "gold_n", "auto_n", "gold_aligned", "auto_aligned", "diagonal", (F.col("gold_aligned") - F.col("diagonal")).alias("off_diagonal"), within.alias("within"))


def rates(aligned: DataFrame) -> DataFrame:
    """One row: instances of either annotation, records of each kind, and shares.

    ``recall`` is aligned (same or changed) over gold instances, ``changed_or_lost`` all gold
    instances but the same ones over them; gold instances are those aligned, one-sided and unclear.
    """
    n = lambda kind, of=None: F.count_if(F.col("kind") == kind) if of is None else F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(of))), F.lit(0))
    counts = aligned.agg(*[n(k).alias(k) for k in KINDS], n("unclear", "n_gold").alias("unclear_gold"), n("unclear", "n_auto").alias("unclear_auto"))
    at = F.col("same") + F.col("changed")
    counts = counts.withColumn("gold_n", at + F.col("gold_only") + F.col("unclear_gold")).withColumn("auto_n", at + F.col("auto_only") + F.col("unclear_auto"))
    return counts.withColumns(
        {
            "aligned": at,
            "to_review": F.col("gold_only") + F.col("auto_only") + F.col("changed") + F.col("unclear"),
            "recall": at / F.col("gold_n"),
            "same_among_aligned": F.col("same") / at,
            "changed_or_lost": (F.col("gold_n") - F.col("same")) / F.col("gold_n"),
        }
    )


#: The reasons' names, in the order they are reported.
REASONS = (
    "relevant_dependency_relation_differs", "subject_relation_differs", "object_relation_differs", "required_relation_retained_but_head_changes", "any_relevant_pos_mismatch",
    "subject_pos_mismatch", "object_pos_mismatch", "predicate_verb_mismatch", "missing_sentence_token_or_unexplained_residual",
)


def reasons(aligned: DataFrame, gold_sentences: DataFrame, auto_sentences: DataFrame, arguments: tuple[str, ...] = ("NOUN",)) -> DataFrame:
    """``(direction, population, reason, n, pct)``: why instances stand in one annotation alone, as the other has their tokens.

    Reasons are not exclusive. An instance whose sentence or token the other annotation lacks, or
    that nothing tested explains, is the last reason's. Sentences are ``(doc_id, line_no, tokens)``.
    """
    token = lambda i: F.get(F.filter("tokens", lambda t: t["id"] == F.col(i)), F.lit(0))

    def one(kind: str, other: DataFrame) -> DataFrame:
        mine = aligned.where(F.col("kind") == kind).select("kind", "doc_id", "line_no", "v", "s", "o")
        seen = mine.join(other.select("doc_id", "line_no", "tokens"), ["doc_id", "line_no"], "left")
        return seen.select("kind", "v", token("v").alias("tv"), token("s").alias("ts"), token("o").alias("to"))

    df = one("gold_only", auto_sentences).union(one("auto_only", gold_sentences))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    found = is_(F.col("tv").isNotNull() & F.col("ts").isNotNull() & F.col("to").isNotNull())
    s_rel, o_rel = is_(F.col("ts.deprel") == "nsubj"), is_(F.col("to.deprel") == "obj")
    s_pos, o_pos, v_pos = is_(F.col("ts.upos").isin(*arguments)), is_(F.col("to.upos").isin(*arguments)), is_(F.col("tv.upos") == "VERB")
    moved = (s_rel & is_(F.col("ts.head") != F.col("v"))) | (o_rel & is_(F.col("to.head") != F.col("v")))
    tests = [~s_rel | ~o_rel, ~s_rel, ~o_rel, moved, ~s_pos | ~o_pos | ~v_pos, ~s_pos, ~o_pos, ~v_pos]
    tests = [found & t for t in tests]
    explained = tests[0] | tests[3] | tests[4]
    flags = df.select("kind", *[t.cast("long").alias(r) for r, t in zip(REASONS, [*tests, ~explained], strict=True)])
    counts = flags.groupBy("kind").agg(F.count("*").alias("population"), *[F.sum(r).alias(r) for r in REASONS])
    rows = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])
    return counts.select(F.col("kind").alias("direction"), "population", F.inline(rows)).withColumn("pct", 100 * F.col("n") / F.col("population"))
