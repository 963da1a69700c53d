"""What the fourth round's findings on the reader queries ask for."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from treeloom.plans import file_queries, treebank
from treeloom.plans.queries import pseudo_misc
from treeloom.sources import conllu
from treeloom.sources.scratch import shared_dir

SMALL = "/root/testdata/sf0.001"
CORPUS = "# first\n# newdoc\n\n# term = zvrst / umetnostna\n\n \t\n1\ta\n2\tb\n\n# x\n1\tc\n\n\n# newdoc\n1\td\n# y\n\n# last, alone\n\n"


def left(spark, mark):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if mark in x}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("attach,genres", [(False, False), (True, False), (False, True), (True, True)])
def test_gz_files_are_read_once(spark, tmp_path, attach, genres):
    """a gz file is one split, so nothing is staged for its ends; its blocks are those of the plain file."""
    texts = [CORPUS, CORPUS.rstrip("\n"), "\n\n", "# a\n", "1\tz"]
    for kind in ("plain", "gz"):
        (tmp_path / kind).mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "plain" / f"{i}.conllu").write_text(text)
        (tmp_path / "gz" / f"{i}.conllu.gz").write_bytes(gzip.compress(text.replace("\n", "\r\n").encode()))
    columns = [F.regexp_extract("file", r"([0-9])\.conllu", 1).alias("k"), "ord", "lines", *(["genre"] if genres else [])]
    before = left(spark, "conllu-edges")
    got, want = (sorted(map(str, conllu.blocks(spark, str(tmp_path / kind), attach=attach, genres=genres).select(*columns).drop("ord").collect())) for kind in ("gz", "plain"))
    assert got == want and got
    assert len(left(spark, "conllu-edges") - before) == 1  # of the plain files
    own = conllu.blocks(spark, f"{tmp_path}/gz/0.conllu.gz", attach=attach).orderBy("ord").collect()
    assert [r.lines[-1] for r in own if not r.lines[-1].startswith("# ") or "# y" in r.lines] == ["2\tb", "1\tc", "# y"]


def test_rendered_trees_equal_those_of_sentences(spark, monkeypatch):
    """the batches' trees are those that expressions make, whatever the batches are cut into."""
    monkeypatch.setattr(treebank, "PIECE", 40)
    odd = ["", None, "\n \n  x  \n", "Ünd ßa İx Σ ǅabcd Éabcd aabcd 1abcd 😀abcd\nab  abc   d  e f g h\n", "z y x w v u t s r\t\r\n a", " abc abc abc abc abc abc abc"]
    docs = spark.createDataFrame([(i, "a", x) for i, x in enumerate(odd)], "doc_id long, lang string, text string").coalesce(1)
    s, none = treebank.sentences(docs, "lang", text=True).where(F.size("tokens") > 0), F.lit("_")
    full = F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["form"].alias("form"), none.alias("lemma"), t["upos"].alias("upos"), none.alias("xpos"), F.when(t["upos"] == "VERB", "VerbForm").otherwise("A=b").alias("feats"), t["head"].alias("head"), t["deprel"].alias("deprel"), none.alias("deps"), pseudo_misc(t).alias("misc")))
    want = s.select("doc_id", "lang", "line_no", "line", full.alias("tokens")).collect()
    assert sorted(map(str, treebank.rendered(docs, "lang", tokens=True).collect())) == sorted(map(str, want)) and len(want) == 6
    text = lambda df: sorted(map(str, df.select("doc_id", "line_no", F.array_join("rows", "\n").alias("v")).collect()))
    assert text(treebank.rendered(docs, "lang")) == text(spark.createDataFrame(want, s.select("doc_id", "lang", "line_no", "line", full.alias("tokens")).schema).select("doc_id", "line_no", F.array(F.array_join(F.transform("tokens", lambda t: F.concat_ws("\t", *[t[c].cast("string") for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")])), "\n")).alias("rows")))


def test_a_split_is_written_and_read_by_many_tasks(spark, tmp_path):
    """a split is a folder of files that tasks write as they read, and an empty one is no error."""
    before = left(spark, "conllu-splits")
    got = {r.split: r.blocks for r in file_queries.split_merge(spark, SMALL).collect()}
    (folder,) = left(spark, "conllu-splits") - before
    path = f"{shared_dir(spark)}/{folder}".removeprefix("file:")
    for i, name in enumerate(("train", "dev", "test")):
        assert len([x for x in os.listdir(f"{path}/xx-{name}.conllu") if x.endswith(".gz")]) > 1
        assert conllu.blocks(spark, f"{path}/xx-{name}.conllu").count() == got[i]
    spark.createDataFrame([(3, "a b", "x", "y")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.split, r.blocks, r.tokens) for r in file_queries.split_merge(spark, str(tmp_path)).collect()] == [(0, 1, 2)]


def test_violations_read_lines_once(spark, tmp_path):
    """one scan finds both broken rows and second texts."""
    (tmp_path / "a.conllu.gz").write_bytes(gzip.compress("﻿# text = a\n# text = b\n# text = c\n1\tx\n\n# text = a\n# text = a\n1\ta\tb\tc\td\te\tf\tg\th\ti\n".encode()))
    v = conllu.violations(spark, str(tmp_path))
    assert scans(v) == 1
    assert sorted((r.rule, r.line) for r in v.collect()) == [("columns", "1\tx"), ("head", "1\ta\tb\tc\td\te\tf\tg\th\ti"), ("text", "# text = b")]


def test_annotation_is_compared_by_sentence(spark, monkeypatch):
    """no token is shuffled where nothing has changed, and what has changed is still counted by token."""
    joined = []
    plain = file_queries.contracts.structure_violations
    monkeypatch.setattr(file_queries.contracts, "structure_violations", lambda *a: joined.append(1) or plain(*a))
    same = {r.what: r.n for r in file_queries.annotation_unchanged(spark, SMALL).collect()}
    assert same["changed"] == 0 and not joined
    annotate = conllu.annotate

    def spoilt(s, tagger):  # two fields of a token in some sentences, and a sentence's last token
        first = F.col("doc_id") + F.col("line_no")
        out = annotate(s, tagger).where("size(tokens) > 1")
        changed = F.transform("tokens", lambda t, i: F.when((first % 50 == 0) & (i == 0), t.withField("lemma", F.lit("x")).withField("deps", F.lit("y"))).otherwise(t))
        return out.withColumn("tokens", F.when(first % 70 == 1, F.slice("tokens", F.lit(1), F.size("tokens") - 1)).otherwise(changed))

    monkeypatch.setattr(conllu, "annotate", spoilt)
    got = {r.what: r.n for r in file_queries.annotation_unchanged(spark, SMALL).collect()}
    s = file_queries._annotated(spark, SMALL).selectExpr("size(tokens) AS n", "(doc_id + line_no) % 50 AS p", "(doc_id + line_no) % 70 AS q").collect()
    assert joined and got["changed"] == sum(1 if x.n == 1 or x.q == 1 else 0 for x in s) + sum(x.n > 1 and x.q != 1 and x.p == 0 for x in s)


def test_digests_tell_fields_apart(spark):
    x = spark.sql("SELECT k, array(named_struct('a', a, 'b', b)) AS t FROM VALUES (1, 'x', null), (2, null, 'x'), (3, 'x', 'x'), (4, 'xx', '') AS v(k, a, b)").withColumn("digest", file_queries.contracts.digest("t", ["a", "b"]))
    assert x.select("digest").distinct().count() == 4
    twice = x.union(x.where("k = 1"))
    assert [r.k for r in file_queries.contracts.differing(x, twice, "k", "digest").collect()] == [1] and file_queries.contracts.differing(twice, twice, "k", "digest").isEmpty()


def test_lines_are_cut_once_when_blocks_are_cleaned(spark):
    """fields are made once a line, not once for each field that is looked at."""
    whole, root = "1\ta\t_\tX\t_\tbad\t_\troot\tbad\t_", "2\tb\t_\tX\t_\tA=b\t1\tobj\t1:obj\t_"
    rows = [("f", 1, ["# c", whole, root]), ("f", 2, [root + "\tmore"]), ("f", 3, [whole.replace("root", "obj"), root]), ("f", 4, ["# alone"])]
    c = conllu.cleaned(spark.createDataFrame(rows, "file string, ord int, lines array<string>"))
    assert c._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1 and c.columns == ["file", "ord", "lines", "dropped"]
    got = {r.ord: (r.dropped, r.lines) for r in c.collect()}
    assert got[1] == (False, ["# c", "1\ta\t_\tX\t_\t_\t0\troot\t_\t_", root]) and got[4] == (False, ["# alone"])
    assert got[2] == (True, rows[1][2]) and got[3] == (True, rows[2][2])
