"""What the third round of review found."""

import hashlib

from treeloom.operators import inference
from treeloom.schema import PATTERNS
from treeloom.sources import conllu, files, tables


def cached(spark, path, write, n):
    total = sum(n)
    rows = [("de", "DE", p, str(k + (p == "VOS")), str(total), write(k / total)) for p, k in zip(PATTERNS, n, strict=True)]
    files.write_tsv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in files.CACHED)), path)
    manifest = spark.createDataFrame([("de", "DE")], "corpus_id string, display_name string")
    return sorted(r.rule for r in files.cache_violations(files.read_cached_counts(spark, path), manifest).collect())


def test_one_count_too_many_shows_in_large_totals(spark, tmp_path):
    """A cache of twelve decimals tells one count of millions apart; one of six decimals is held to those."""
    n = [9_000_001, 4_000_003, 1_000_007, 2_000_003, 5_000_011, 3_000_017]
    assert cached(spark, str(tmp_path / "twelve"), lambda x: f"{x:.12f}", n) == ["proportion", "sum"]
    assert cached(spark, str(tmp_path / "six"), lambda x: f"{x:.6f}", n) == ["sum"]


def test_only_buckets_in_which_a_share_ends_are_ordered(spark, monkeypatch):
    """Labels follow the order of hashes; what is shuffled by bucket is a small part of the drawn rows."""
    units = spark.range(400).selectExpr("id as u", "id % 3 as g")
    monkeypatch.setattr(inference, "DIGITS", 2)
    drawn = inference.hash_permuted(units, "u", "g", 4)
    for k in range(1, 5):
        order = sorted(range(400), key=lambda u: hashlib.md5(f"{k}-{u}".encode()).hexdigest())
        want = dict(zip(order, sorted(u % 3 for u in range(400)), strict=True))
        assert {r.u: r.drawn for r in drawn.where(f"replicate = {k}").collect()} == want
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    ordered = [x for x in plan.splitlines() if "row_number()" in x]
    assert len(ordered) == 1 and "Union" in plan  # the rest of the rows passes without a window


def test_tables_of_many_files_are_read_as_they_lie(spark, tmp_path):
    """Rows of a small table in one file are dealt out; those of as many files as cores stay where they are."""
    rows = spark.range(1000)
    rows.repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    planned = lambda name: tables.load(spark, str(tmp_path), name)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in planned("many") and "Repartition" in planned("one")


def test_blocks_within_a_split_are_not_shuffled(spark, tmp_path):
    """The blocks that lie within a split come straight from the scan, with no window, grouping or sort over their lines."""
    (tmp_path / "a.conllu").write_text("# x\n\n1\ta\n2\tb\n\n1\tc\n \t\n1\td\n\n# tail\n")
    b = conllu.blocks(spark, str(tmp_path), attach=True)
    whole = b._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "MapInArrow" in whole and not any(x in whole for x in ("Window", "Aggregate", "Sort"))
    assert [r.lines for r in b.orderBy("ord").collect()] == [["# x", "1\ta", "2\tb"], ["1\tc"], ["1\td"]]
