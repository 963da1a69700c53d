"""What the third round's findings on the reader queries and the stream ask for."""

import os
import random

from treeloom.operators import repetition
from treeloom.plans import file_queries
from treeloom.schema import PATTERNS
from treeloom.sources import conllu
from treeloom.sources.scratch import shared_dir
from treeloom.streaming import counts, first_seen

SMALL = "/root/testdata/sf0.001"


def plans(spark, mark):
    """The physical plans of the executions so far that hold ``mark``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [x for x in (found.apply(i).physicalPlanDescription() for i in range(found.size())) if mark in x]


def test_folders_are_written_unsorted(spark, tmp_path):
    """no sort of what is written, which spills it all; a folder's rows stay in order."""
    rows = spark.range(0, 600, 1, 2).selectExpr("id", "concat('k', id % 3) AS k", "array(concat('# sent_id = ', id)) AS comments")
    tokens = "array(struct(1 AS id, 'a' AS form, '_' AS lemma, 'X' AS upos, '_' AS xpos, '_' AS feats, 0 AS head, 'root' AS deprel, '_' AS deps, '_' AS misc)) AS tokens"
    conllu.write_conllu(rows.selectExpr("*", tokens), str(tmp_path / "by"), by="k")
    (plan,) = plans(spark, str(tmp_path / "by"))
    assert "Sort" not in plan
    back = [(r.file, int(r.comments[0].rsplit(" ", 1)[1])) for r in conllu.read_conllu(spark, f"{tmp_path}/by/*").collect()]
    assert sorted(i for _, i in back) == list(range(600)) and all(f"k={'k'}{i % 3}" in f for f, i in back)
    for name in {f for f, _ in back}:
        own = [int(x.rsplit(" ", 1)[1]) for x in spark.read.text(name).where("value LIKE '# sent%'").toPandas()["value"]]
        assert own == sorted(own)


def test_files_of_documents_are_written_without_sorting_blocks(spark):
    """texts are put in order before blocks are made of them, so neither windows nor sorts hold blocks."""
    path = file_queries._in_files(spark, SMALL, "conllu-unsorted")
    (plan,) = [x for x in plans(spark, path) if "InsertIntoHadoopFsRelationCommand" in x]
    assert "Window" not in plan and plan.split("== Initial Plan ==")[0].count("Sort ") <= 2  # in the tree and in its details: of texts
    opened = conllu.blocks(spark, path, recursive=True).where("startswith(lines[0], '# newdoc')").count()
    assert opened == file_queries.docs(spark, SMALL).where("lang is not null and replace(replace(text, ' ', ''), '\n', '') != ''").count()


def test_a_corpus_lies_there_once_at_a_time(spark):
    """F8: the LF files have gone when the CRLF files are written."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert file_queries.conllu_plain_and_crlf(spark, SMALL).count() == 2
    assert not [x for x in set(os.listdir(folder)) - before if "conllu-lf" in x]


def test_first_seen_states_total_the_batch(spark, tmp_path):
    """the state is Spark's own aggregation, with no Python for each identity; earlier copies that come late take the first one's place."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), i // 2, i % 2, rng.choice(["x", "y", "z", None, "é" * 9]), *[rng.randrange(4) for _ in PATTERNS]) for i in range(80)]
    schema = "scope string, major long, minor long, line string, " + ", ".join(f"n_{p} long" for p in PATTERNS)
    want = {r.scope: r.asDict() for r in repetition.counts_before_after(spark.createDataFrame(rows, schema), "line", "major", "minor", scope=("scope",)).collect()}
    rng.shuffle(rows)
    with counts.rocksdb_state(spark):
        for k in range(3):
            spark.createDataFrame(rows[k::3], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
            states = first_seen.states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "scope", "line", "major", "minor")
            write = first_seen.appended(str(tmp_path / "out"))
            q = states.writeStream.outputMode("update").foreachBatch(lambda batch, n, write=write: (write(batch, n), write(batch, n))[0]).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert "Python" not in q._jsq.explainInternal(False) and "Pandas" not in q._jsq.explainInternal(False)
    got = {r.scope: r.asDict() for r in first_seen.state_totals(spark.read.schema(first_seen.STATES).parquet(str(tmp_path / "out"))).collect()}
    assert {k: {c: v[c] for c in want[k]} for k, v in got.items()} == want
    assert {k: (v["sentences"], v["kept"]) for k, v in got.items()} == {s: (sum(r[0] == s for r in rows), len({r[3] for r in rows if r[0] == s})) for s in ("a", None)}


def test_lines_are_cut_once_and_only_what_is_asked_for_is_made(spark, tmp_path):
    """a line is split into fields once, and neither texts nor other token fields pass through the tasks of a query that doesn't use them."""
    (tmp_path / "a.conllu").write_text("﻿# lang = a\n2\tB\tb\tVERB\t_\t_\t0\troot\t_\t_\n1-2\tAB\t_\t_\t_\t_\t_\t_\t_\t_\n1\tA\ta\tNOUN\t_\t_\tx\tobj\t_\t_\n2\tC\tc\tNOUN\t_\t_\t1\tnsubj\t_\t_\n3\tshort\n\n")
    s = conllu.read_conllu(spark, str(tmp_path), strict=True)
    plan = s.select("comments", "tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_join" not in plan
    few = conllu.read_conllu(spark, str(tmp_path), strict=True, names=file_queries.MATCHED).select("text", "tokens").first()
    assert (few.text, [tuple(t) for t in few.tokens]) == ("B A C short", [(1, "NOUN", 0, "obj"), (2, "NOUN", 1, "nsubj")])
    assert [tuple(t[c] for c in file_queries.MATCHED) for t in s.first().tokens] == [tuple(t) for t in few.tokens]
    query = file_queries.conllu_roundtrip_counts(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert query.count("split(") == 1 and "array_join" not in query and "AS lemma" not in query
