"""The data source, keyed state, progress, resumable runs, watched scans and the claim catalogue against plain versions."""

import gzip
import math
import random
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from treeloom.operators import claims as C, contracts, repetition as R, runs
from treeloom.schema import PATTERNS
from treeloom.sources import conllu, conllu_source, files
from treeloom.streaming import counts, first_seen, progress


def corpus(rng, n, ends="\n", last=True):
    out = []
    for i in range(n):
        if rng.random() < 0.2:
            out += [f"# newdoc id = {i}", ""]
        out += [f"# sent_id = {i}"] + ([f"# text = t{i} é"] if rng.random() < 0.7 else [])
        for k in range(1, rng.randrange(2, 6)):
            out.append("\t".join([str(k), f"w{k}é", "l", rng.choice(["VERB", "NOUN"]), "x", "_", rng.choice(["0", "1", "_"]), rng.choice(["nsubj", "obj"]), "_", "_"][: rng.choice([10, 10, 8, 5])]))
        out += ["1-2\tw\t_\t_\t_\t_\t_\t_\t_\t_"][: rng.randrange(2)] + rng.choice([[""], ["", " \t"], ["", ""]])
    return ends.join(out) + (ends if last else "")


def as_read(df):
    return sorted([(r.file[-10:], list(r.comments), [tuple(t) for t in r.tokens], r.text, r.is_fallback) for r in df.collect()], key=repr)


@pytest.mark.parametrize("split", [37, 500, 1 << 20])
def test_data_source_equals_the_reader(spark, tmp_path, split):
    rng = random.Random(split)
    for k, (ends, last) in enumerate([("\n", True), ("\r\n", True), ("\n", False)]):
        (tmp_path / f"c{k}.conllu").write_text(corpus(rng, 40, ends, last), newline="")
    (tmp_path / "z9.conllu.gz").write_bytes(gzip.compress(corpus(rng, 30).encode()))
    (tmp_path / "_hidden.conllu").write_text("1\ta\n")
    conllu_source.register(spark)
    got = spark.read.format("conllu").option("split", split).load(str(tmp_path))
    assert got.schema == conllu_source.SENTENCES
    assert as_read(got) == as_read(conllu.read_conllu(spark, str(tmp_path)))
    places = {(r.file, r.place): r.text for r in got.collect()}
    assert [t for _, t in sorted(places.items())] == [r.text for r in conllu.read_conllu(spark, str(tmp_path)).orderBy("file", "ord").collect()]
    texts = spark.read.format("conllu").schema("text string").option("split", split).load(str(tmp_path))
    assert texts.columns == ["text"] and sorted(r.text for r in texts.collect()) == sorted(places.values())


def test_tokens_and_pushed_filters(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(corpus(random.Random(3), 60))
    conllu_source.register(spark)
    want = conllu.read_conllu(spark, str(tmp_path)).select(F.explode("tokens").alias("t")).select("t.*")
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, None)
    for push in ("false", "true"):
        spark.conf.set(key, push)
        t = spark.read.format("conllu").option("rows", "tokens").option("pushdown", push).load(str(tmp_path))
        for test in ("upos = 'VERB'", "upos in ('VERB', 'NOUN') and deprel = 'obj'", "id > 1 and upos = 'NOUN'", "upos is null"):
            got = t.where(test).drop("file", "place")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.where(test).collect()), key=repr)
    reader = conllu_source.FilteringReader(conllu_source.TOKENS, {"path": str(tmp_path), "rows": "tokens"})
    left = list(reader.pushFilters([conllu_source.EqualTo(("upos",), "VERB"), conllu_source.EqualTo(("id",), 1)]))
    assert [f.attribute for f in left] == [("id",)] and all(r[5] == "VERB" for p in reader.partitions() for r in reader.read(p))
    if before is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, before)


def test_data_source_streams_new_files(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    conllu_source.register(spark)
    for k in range(3):
        (tmp_path / "in" / f"f{k}.conllu").write_text(f"# text = s{k}\n1\ta\t_\tX\t_\t_\t0\troot\t_\t_\n\n# text = r{k}\n1\tb\t_\tX\t_\t_\t0\troot\t_\t_\n")
        os.utime(tmp_path / "in" / f"f{k}.conllu", ns=(k + 1, k + 1))
        q = spark.readStream.format("conllu").option("split", 30).load(str(tmp_path / "in")).select("text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"{c}{i}" for i in range(k + 1) for c in "rs")


def test_missing_input_is_an_error(spark, tmp_path):
    conllu_source.register(spark)
    with pytest.raises(Exception, match="none.conllu"):
        spark.read.format("conllu").load(str(tmp_path / "none.conllu")).collect()


@pytest.mark.parametrize("batches", [1, 4])
def test_first_seen_totals_equal_the_batch(spark, tmp_path, batches):
    """Whatever the order of arrival: earlier copies that come late correct what was said."""
    rng = random.Random(batches)
    rows = [(rng.choice(["a", None]), i, 0, rng.choice(["x", "y", "z", None, "é" * 9]), *[rng.randrange(4) for _ in PATTERNS]) for i in range(80)]
    schema = "scope string, major long, minor long, line string, " + ", ".join(f"n_{p} long" for p in PATTERNS)
    batch = R.counts_before_after(spark.createDataFrame(rows, schema), "line", "major", "minor", scope=("scope",))
    want = {r.scope: r.asDict() for r in batch.collect()}
    rng.shuffle(rows)
    with counts.rocksdb_state(spark):
        for k in range(batches):
            spark.createDataFrame(rows[k::batches], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = first_seen.changes(stream, "scope", "line", "major", "minor").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination()
    got = {r.scope: r.asDict() for r in first_seen.totals(spark.read.schema(first_seen.CHANGES).parquet(str(tmp_path / "out"))).collect()}
    assert {k: {c: v[c] for c in want[k]} for k, v in got.items()} == want
    assert {k: (v["sentences"], v["kept"]) for k, v in got.items()} == {s: (sum(r[0] == s for r in rows), len({r[3] for r in rows if r[0] == s})) for s in ("a", None)}


def test_stream_progress(spark, tmp_path):
    listener, told = progress.StreamProgress(total=30), []
    listener.tell = told.append
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").queryName("steps").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if str(q.runId) in listener.ended:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    steps = listener.steps[str(q.runId)]
    rows = [s.rows for s in steps]
    assert rows == sorted(rows) and len(set(rows)) >= 3 and rows[-1] == 30 == spark.read.parquet(str(tmp_path / "out")).count()
    assert steps[-1].share == 1 and steps[-1].left == 0 and steps[0].left > 0 and "steps" in steps[0].line() and told == steps
    assert listener.ended[str(q.runId)] is None


def test_batch_progress(spark, tmp_path):
    """Counts rise while a job runs and end at the input's rows."""
    spark.range(400).repartition(20).write.parquet(str(tmp_path / "in"))
    key, told = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    spark.conf.set(key, "600")

    @F.pandas_udf("long")
    def slow(x):
        import time

        time.sleep(0.25)
        return x

    try:
        n = progress.watch(spark, "scan", lambda: spark.read.parquet(str(tmp_path / "in")).select(slow("id").alias("x")).agg(F.sum("x")).first()[0], told.append, every=0.2)
    finally:
        spark.conf.set(key, before)
    rows = [s.rows for s in told]
    assert n == sum(range(400)) and rows == sorted(rows) and len(set(rows)) >= 3 and rows[-1] == 400
    assert any(s.left for s in told) and told[-1].share > 0.9 and "scan" in told[-1].line()
    with pytest.raises(ZeroDivisionError):
        progress.watch(spark, "bad", lambda: 1 / 0, told.append)


def test_runs_are_taken_up_again(spark, tmp_path):
    path, calls = str(tmp_path / "runs"), []

    def work(name):
        calls.append(name)
        if name == "bad" and len(calls) < 4:
            raise ValueError("no such corpus")
        return spark.range(5 if name == "a" else 7)

    inputs = [("a", "1"), ("bad", "1"), ("b", "1")]
    first = {r.name: (r.status, r.error, r.n) for r in runs.run_corpora(spark, inputs, work, path).collect()}
    assert first == {"a": ("ok", None, 5), "bad": ("error", "no such corpus", None), "b": ("ok", None, 7)}
    second = {r.name: r.status for r in runs.run_corpora(spark, inputs, work, path).collect()}
    assert second == {"a": "kept", "bad": "ok", "b": "kept"} and calls == ["a", "bad", "b", "bad"]
    changed = [("a", "2"), *inputs[1:]]
    assert {r.name: r.status for r in runs.run_corpora(spark, changed, work, path).collect()} == {"a": "ok", "bad": "kept", "b": "kept"}
    assert runs.results(spark, path, "id long").count() == 5 + 5 + 7 + 7 and runs.results(spark, path, "id long", changed).count() == 5 + 7 + 7
    assert runs.results(spark, str(tmp_path / "nothing"), "id long").collect() == []


def test_a_killed_run_leaves_no_rows(spark, tmp_path):
    """A process that dies while it writes its second corpus; the rerun gives the same table as one that was never stopped."""
    code = f"""
        import os, sys
        sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
        from pyspark.sql import SparkSession, functions as F
        from treeloom.operators import runs
        spark, driver = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate(), os.getpid()
        @F.pandas_udf("long")
        def dies(x):
            if x.max() > 800:
                os.kill(driver, 9)
            return x
        work = lambda name: spark.range(100) if name == "a" else spark.range(0, 1000, 1, 4).select(dies("id").alias("id"))
        runs.run_corpora(spark, [("a", "1"), ("b", "1")], work, {str(tmp_path / "runs")!r})
    """
    died = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, timeout=180)
    assert died.returncode == -9
    path = str(tmp_path / "runs")
    assert [r["name"] for r in runs.committed(spark, path).collect()] == ["a"]
    again = {r.name: r.status for r in runs.run_corpora(spark, [("a", "1"), ("b", "1")], lambda name: spark.range(100 if name == "a" else 1000), path).collect()}
    assert again == {"a": "kept", "b": "ok"}
    assert {r["name"]: r["count"] for r in runs.results(spark, path, "id long").groupBy("name").count().collect()} == {"a": 100, "b": 1000}


@pytest.mark.parametrize("change", ["none", "longer", "touched", "gone", "more"])
def test_watched_scans(spark, tmp_path, change):
    import os

    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("a\nb\n")
    rows, watch = files.watched(spark, str(tmp_path), lambda p: spark.read.text(p))
    if change == "longer":
        (tmp_path / "f1.txt").write_text("a\nb\nc\n")
    elif change == "touched":
        os.utime(tmp_path / "f1.txt", (1, 1))
    elif change == "more":
        (tmp_path / "f3.txt").write_text("x\n")
    assert rows.columns == ["value"] and rows.groupBy().count().first()[0] >= 6
    if change == "gone":
        (tmp_path / "f2.txt").unlink()
    if change == "none":
        assert [n for _, n, _ in watch.check()] == [4, 4, 4]
    else:
        with pytest.raises(files.ChangedInput):
            watch.check()


def test_publication_is_undone(spark, tmp_path, monkeypatch):
    """If the second output can't be renamed the first goes again."""
    done, rename = [], files.rename

    def once(spark_, path, to):
        if done:
            raise OSError("full")
        done.append(to)
        rename(spark_, path, to)

    monkeypatch.setattr(files, "rename", once)
    with pytest.raises(OSError, match="full"):
        files.publish(spark, {str(tmp_path / "a"): spark.range(2), str(tmp_path / "b"): spark.range(3)})
    assert len(done) == 1 and list(tmp_path.iterdir()) == []


def test_grid_order(spark):
    grid = spark.createDataFrame([(i, k) for i, k in enumerate("abcd")], "i int, k string")
    swapped = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "d")], "i int, k string")
    assert contracts.grid_violations(grid, grid, "i").count() == 0 and contracts.grid_violations(swapped, grid.select("k")).count() == 0
    assert sorted((r.k, r.rule) for r in contracts.grid_violations(swapped, grid, "i").collect()) == [("b", "order"), ("c", "order")]


def test_digests_of_any_length(spark, tmp_path):
    import hashlib

    for name, data in (("a", b""), ("b", b"x" * 100_000)):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.length, r.sha256) for r in files.streamed_digests(spark, str(tmp_path), 1000).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a", b""), ("b", b"x" * 100_000))}


def plain_margin(kind, t, o, m):
    """``t``, ``o``, ``m``: values by name of targets, others and the rest of a range."""
    return {
        "above": lambda: min(t.values()) - max(o.values()),
        "below": lambda: min(o.values()) - max(t.values()),
        "positive": lambda: min(t.values()),
        "majority": lambda: sum(v < min(t.values()) for v in o.values()) - len(o) / 2,
        "closer": lambda: sum(t[n] < o[n] for n in t) - len(t) / 2,
        "range": lambda: min(t.values()) - max(o.values()) - (max(m.values()) - min(m.values())),
    }[kind]()


def test_claim_catalogue(spark):
    rng = random.Random(9)
    names = [f"g{i}" for i in range(7)]
    vectors = {s: {n: [rng.randrange(1, 60) + (200 if n == "g0" else 0) * (k == 0) for k in range(6)] for n in names} for s in ("before", "after")}
    share = lambda v: [x / sum(v) for x in v]
    entropy = lambda v: -sum(p * math.log(p) for p in share(v) if p)

    def distance(a, b):
        return math.sqrt(max(0, sum(p * math.log2(2 * p / (p + q)) + q * math.log2(2 * q / (p + q)) for p, q in zip(share(a), share(b), strict=True)) / 2))

    def value(state, measure, anchor, name):
        v = vectors[state][name]
        if measure == "distance":
            return distance(vectors[state][anchor], v)
        return {"entropy": entropy(v), "lead": v[0] - 2 * max(v[1:])}.get(measure) if measure in ("entropy", "lead") else share(v)[PATTERNS.index(measure[6:])]

    claims = [
        C.highest("h", "share_OVS", "g1", names), C.lowest("l", "entropy", "g0", names), C.exceeds("e", "entropy", "g2", "g3"), C.dominant("d0", "g0"), C.dominant("d1", "g1"), C.above_majority("m", "entropy", "g4", names),
        C.gap_beyond_range("r", "share_SVO", "g0", "g1", names[2:]), C.nearest("n", "g5", ["g1", "g2"], names), C.farthest("f", "g5", ["g0", "g6"], names), C.closer_to_majority("c", "g2", "g0", names),
    ]
    df = spark.createDataFrame([(n, vectors["before"][n], vectors["after"][n]) for n in names], "name string, before array<long>, after array<long>")
    long = C.measures(df, "name")
    got = {(r.label, r.state): r.margin for r in C.margins(C.catalogue(spark, [*claims, C.exceeds("x", "entropy", "nobody", "g1")]), long).collect()}
    for c in claims:
        for state in ("before", "after"):
            by = {r: {n: value(state, m, a, n) for role, m, a, n in c.items if role == r} for r in ("target", "other", "among")}
            assert got[c.label, state] == pytest.approx(plain_margin(c.kind, *by.values()), abs=1e-12), c
    assert got["x", "before"] is None and len(got) == 22
    derived = {r.label: {i.name for i in r["items"] if i.role == "target"} for r in C.nearest_sets(long, 2).collect()}
    order = sorted((distance(vectors["before"]["g5"], vectors["before"][n]), n) for n in names if n != "g5")
    near, far = sorted(n for _, n in order[:2]), sorted(n for _, n in order[-2:])
    assert derived[f"g5: nearest {', '.join(near)}"] == set(near) and derived[f"g5: farthest {', '.join(far)}"] == set(far) and len(derived) == 14
    assert all(r.before > 0 for r in C.judged(C.nearest_sets(long, 2), long).collect())  # as they are made from it
