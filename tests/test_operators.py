import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.functions.special import chi2_sf, fisher_two_sided, sign_test, wilcoxon
from treeloom.operators import distributions as D, inference as I, matching as M, ordered, repetition as R, resampling as S
from treeloom.operators.contracts import distribution_violations, grid_violations
from treeloom.plans import registry
from treeloom.schema import PATTERNS
from treeloom.sources import conllu, files


def sentence(*rows):
    return [dict(zip(("id", "form", "upos", "head", "deprel"), r, strict=True)) for r in rows]


def orders(spark, *sentences, query=M.NOUNS):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "k long, tokens array<struct<id:int,form:string,upos:string,head:int,deprel:string>>")
    found = {}
    for f in (M.match, M.match_by_join):
        found[f.__name__] = sorted((r.k, r.s.id, r.v.id, r.o.id, r.pattern) for r in f(df, query).collect())
    assert found["match"] == found["match_by_join"]
    counted = {(r.k, p): r[f"n_{p}"] for r in M.count_in_row(df, query).collect() for p in PATTERNS}
    assert counted == {(k, p): sum(x[0] == k and x[4] == p for x in found["match"]) for k in range(len(sentences)) for p in PATTERNS}
    return found["match"]


def test_each_order_once(spark):
    places = [(1, 2, 3), (1, 3, 2), (2, 1, 3), (3, 1, 2), (3, 2, 1), (2, 3, 1)]  # s, v, o
    made = [sentence((s, "a", "NOUN", v, "nsubj"), (v, "b", "VERB", 0, "root"), (o, "c", "NOUN", v, "obj")) for s, v, o in places]
    assert sorted(x[4] for x in orders(spark, *made)) == sorted(PATTERNS)


def test_all_pairs_and_exclusions(spark):
    rows = sentence(
        (1, "o", "NOUN", 3, "obj"), (2, "o", "NOUN", 3, "obj"), (3, "v", "VERB", 0, "root"), (4, "s", "NOUN", 3, "nsubj"), (5, "s", "NOUN", 3, "nsubj"),
        (6, "p", "PROPN", 3, "obj"), (7, "i", "NOUN", 3, "iobj"), (8, "n", "NOUN", 3, "nsubj:pass"), (9, "x", "AUX", 0, "root"), (10, "s", "NOUN", 9, "nsubj"), (11, "o", "NOUN", 9, "obj"),
    )
    assert [x[4] for x in orders(spark, rows)] == ["OVS"] * 4
    assert len(orders(spark, rows, query=M.NOUNS_AND_NAMES)) == 6
    collapsed = M.TreeQuery.parse("upos=VERB >nsubj upos=NOUN >obj upos=NOUN", collapse_subtypes=True)
    assert len(orders(spark, rows, query=collapsed)) == 6


def test_long_and_odd_sentences(spark):
    long = [(i, "w", ("NOUN", "VERB", "NOUN")[i % 3], i - i % 3 + 1, ("nsubj", "root", "obj")[i % 3]) for i in range(1, 1500)]
    twice = sentence((1, "s", "NOUN", 2, "nsubj"), (2, "v", "VERB", 0, "root"), (2, "w", "VERB", 0, "root"), (3, "o", "NOUN", 2, "obj"), (4, "o", "NOUN", -3, "obj"))
    found = orders(spark, sentence(*long), [], None, twice)
    assert len(found) == 499 + 2 and {x[4] for x in found if x[0] == 0} == {"SVO"} and M.match(spark.createDataFrame([], "k long, tokens array<struct<id:int,upos:string,head:int,deprel:string>>")).count() == 0


def test_query_language():
    assert M.TreeQuery.parse("upos=VERB >nsubj _ >obj _") == M.BROAD
    assert M.TreeQuery.parse("upos=VERB >nsubj upos=NOUN|PROPN >obj upos=NOUN|PROPN") == M.NOUNS_AND_NAMES
    for bad in ("upos=VERB >nsubj _", "lemma=x >nsubj _ >obj _"):
        with pytest.raises(ValueError):
            M.TreeQuery.parse(bad)


def test_misc(spark):
    rows = [("A=x|ner=b-per|NER=O",), ("NER=I-loc",), ("_",), ("SpaceAfter=No",), ("NER=O|NER=B-x",)]
    df = spark.createDataFrame(rows, "m string").select("m", M.ner_status(F.col("m")).alias("s"), M.misc_upsert(F.col("m"), F.lit("O")).alias("u"))
    assert [(r.s, r.u) for r in df.collect()] == [("entity", "A=x|NER=O"), ("entity", "NER=O"), ("common", "NER=O"), ("common", "SpaceAfter=No|NER=O"), ("common", "NER=O")]


def test_linear_trees(spark):
    cases = {"A <nsubj B >obj C": "SVO", "A <nsubj C <obj B": "SOV", "B >nsubj A >obj C": "VSO", "B >obj A": "", "A <x B >obj C": "", "": "", "A <nsubj >> >obj C": "SVO", "<nsubj B >obj C A": "", "A >nsubj <obj B C": "OSV", ">nsubj >obj A v B <nsubj": "OVS"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", M.classify_linear(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases


def test_metrics(spark):
    rows = [("u", [5.0] * 6), ("one", [3.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, x array<double>").select("k", D.entropy(D.shares_of(F.col("x"))).alias("e"))
    got = {r.k: r.e for r in df.collect()}
    assert got["u"] == pytest.approx(math.log(6)) and got["one"] == 0
    p = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.5, 0.5])], "a array<double>, b array<double>, c array<double>")
    r = p.select(D.jensen_shannon(F.col("a"), F.col("b")).alias("far"), D.jensen_shannon(F.col("c"), F.col("c")).alias("same"), D.cosine(F.col("a"), F.col("b")).alias("cos")).first()
    assert r.far == pytest.approx(1) and r.same == 0 and r.cos == 0


def test_tails():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(10, 2) == pytest.approx(math.exp(-5))
    assert fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert sign_test(249, 361) == pytest.approx(4.309e-13, rel=1e-3)
    assert sign_test(0, 0) == 1 and sign_test(5, 10) == 1 and sign_test(0, 3) == pytest.approx(0.25)
    assert fisher_two_sided(0, 5, 0, 7) == 1 and 0 <= fisher_two_sided(10**6, 10**6, 10**6 + 500, 10**6) < 1  # no array as long as the counts
    for a, b, c, d in ((8, 2, 1, 5), (10, 0, 3, 7), (2, 30, 14, 4)):
        pmf = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        assert fisher_two_sided(a, b, c, d) == pytest.approx(sum(v for v in pmf.values() if v <= pmf[a] * (1 + 1e-7)) / sum(pmf.values()))
    w, p = wilcoxon(np.array([1, 2, -3, 0, 4]))
    assert (w, round(p, 4)) == (3.0, 0.4652)


def test_holm_and_permutation(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r.k: round(r.p_holm, 6) for r in D.holm(df, "f", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    same, far = np.array([[30, 30], [30, 30]]), np.array([[60, 5], [5, 60]])
    assert I.permuted_labels(same, 1, 200) == 1 and I.permuted_labels(far, 1, 200) == pytest.approx(1 / 201)
    clusters = np.repeat([[10, 0], [0, 10]], 6, axis=0)
    assert I.permuted_clusters(clusters, [6, 6], 1, 200) < 0.05
    assert I.swapped_pairs(np.array([[9, 1]] * 12), np.array([[1, 9]] * 12), 1, 200) < 0.05
    ci = I.bootstrap(np.array([[5, 1, 1, 1, 1, 1]] * 8), np.random.default_rng(1), 50)
    assert ci["svo_lo"] == ci["svo_hi"] == pytest.approx(0.5)


def test_exact_stream_runs_by_pair(spark):
    pairs = spark.createDataFrame([("a", "b", [30, 10, 0, 0, 0, 0], [10, 30, 0, 0, 0, 0], 7)], "group_a string, group_b string, a array<long>, b array<long>, seed long")
    r = I.exact_pair_tests(pairs, 100).first()
    assert r.p == I.permuted_labels(np.array([[30, 10], [10, 30]]), 7, 100) and r.chi2 == pytest.approx(20)


def test_groups_clusters_and_pairs_by_numpy_streams(spark):
    genres = spark.createDataFrame([("genres", [LITERARY, PUBLICISTIC, PROFESSIONAL], 20260715)], "name string, cells array<array<long>>, seed long")
    r = I.exact_group_tests(genres).first()
    assert (round(r.chi2, 6), round(r.p, 6)) == (13.765731, 0.183991)  # published
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3], *rng.integers(0, 9, 6).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "u long, g string, " + ", ".join(f"n_{p} long" for p in PATTERNS))
    families = spark.createDataFrame([("a-b", ["a", "b"], 5), ("all", ["c", "a", "b"], 6)], "name string, members array<string>, seed long")
    got = {r.name: r for r in I.exact_cluster_tests(df.repartition(3), families, "u", "g", 300).collect()}
    of = lambda g: np.array([r[2:] for r in rows if r[1] == g])
    for name, members, seed in (("a-b", "ab", 5), ("all", "cab", 6)):
        counts = [of(g) for g in members]
        assert got[name].p == I.permuted_clusters(np.concatenate(counts), [len(c) for c in counts], seed, 300)
        assert got[name].chi2 == pytest.approx(I.chi_square_of(np.stack([c.sum(axis=0) for c in counts])))
    swap = I.exact_swap_test(df, "u", ["n_SVO", "n_SOV"], ["n_VSO", "n_VOS"], 7, 300).first()
    assert (swap.pairs, swap.p) == (60, I.swapped_pairs(np.array([r[2:4] for r in rows]), np.array([r[4:6] for r in rows]), 7, 300))
    boot, stream = {r.g: r for r in I.exact_bootstrap(df, ("b", "a"), "u", "g", 8, 200).collect()}, np.random.default_rng(8)
    for g in ("b", "a"):
        want = I.bootstrap(of(g), stream, 200)
        assert boot[g].clusters == 20 and [boot[g][k] for k in want] == list(want.values())


def test_hashed_permutations_keep_group_sizes(spark, monkeypatch):
    monkeypatch.setattr(I, "DIGITS", 1)  # many units a bucket
    rows = [(i, "xyz"[i % 3], "p" if i < 40 else "q") for i in range(90)]
    df = spark.createDataFrame(rows, "u long, g string, part string")
    drawn = I.hash_permuted(df, "u", "g", 5, by=("part",)).collect()
    got = {(r.replicate, r.u): r.drawn for r in drawn}
    assert len(drawn) == 6 * 90 and all(got[0, u] == g for u, g, _ in rows)
    for part in "pq":
        own = [(u, g) for u, g, x in rows if x == part]
        for k in range(1, 6):
            order = sorted((hashlib.md5(f"{k}-{u}".encode()).hexdigest(), u) for u, _ in own)
            assert [got[k, u] for _, u in order] == sorted(g for _, g in own)


def aligned(spark, gold, auto):
    from treeloom.operators import agreement

    df = lambda rows: spark.createDataFrame([(1, 1, v, s, o, p) for v, s, o, p in rows], "doc_id long, line_no int, v int, s int, o int, pattern string")
    return agreement.align(df(gold), df(auto))


def test_alignment(spark):
    gold = [(2, 1, 3, "SVO"), (5, 4, 6, "SVO"), (9, 8, 10, "SVO"), (12, 11, 13, "SVO"), (12, 11, 14, "SVO"), (20, 19, 21, "SVO"), (30, 29, 31, "SVO"), (30, 28, 33, "OSV")]
    auto = [(2, 1, 3, "SVO"), (5, 6, 4, "OVS"), (9, 7, 10, "SVO"), (12, 11, 15, "SVO"), (25, 24, 26, "VSO"), (30, 29, 32, "SVO"), (30, 33, 34, "VSO"), (30, 35, 36, "VSO")]
    got = sorted((r.v, r.kind, r.gold, r.auto, r.n_gold, r.n_auto, r.s, r.o) for r in aligned(spark, gold, auto).collect())
    assert got == sorted([
        (2, "same", "SVO", "SVO", 1, 1, None, None), (5, "changed", "SVO", "OVS", 1, 1, None, None), (9, "unclear", "SVO", "SVO", 1, 1, None, None), (12, "unclear", None, "SVO", 2, 1, None, None),
        (20, "gold_only", "SVO", None, 1, 0, 19, 21), (25, "auto_only", None, "VSO", 0, 1, 24, 26), (30, "unclear", "SVO", "SVO", 1, 1, None, None), (30, "unclear", "OSV", "VSO", 1, 1, None, None), (30, "auto_only", None, "VSO", 0, 1, 35, 36),
    ], key=lambda x: x)


#: Published counts of two comparisons, and their rates in per cent.
AGREEMENT = [
    ({"same": 1780, "changed": 8, "gold_only": 177, "auto_only": 89}, (4, 4, 5), 1969, 1882, 278, 90.80751650584052, 99.55257270693512, 9.598781107160995),
    ({"same": 2300, "changed": 10, "gold_only": 217, "auto_only": 116}, (15, 15, 19), 2542, 2445, 358, 90.87332808811959, 99.56709956709956, 9.520062942564909),
]


@pytest.mark.parametrize("kinds,unclear,gold_n,auto_n,review,recall,same,lost", AGREEMENT)
def test_published_agreement(spark, kinds, unclear, gold_n, auto_n, review, recall, same, lost):
    from treeloom.operators import agreement

    rows = [(k, 1, 1) for k, n in kinds.items() for _ in range(n)]
    n, g, a = unclear
    rows += [("unclear", 1, 1 + (i < a - g)) for i in range(n)]
    r = agreement.rates(spark.createDataFrame(rows, "kind string, n_gold long, n_auto long")).first()
    assert (r.gold_n, r.auto_n, r.to_review) == (gold_n, auto_n, review)
    assert [100 * x for x in (r.recall, r.same_among_aligned, r.changed_or_lost)] == pytest.approx([recall, same, lost])


#: The published matrix of gold and automatic orders, and both counts.
MATRIX = {("SVO", "SVO"): 1321, ("SOV", "SOV"): 100, ("VSO", "VSO"): 68, ("VOS", "VOS"): 30, ("OSV", "OSV"): 23, ("OVS", "SVO"): 8, ("OVS", "OVS"): 238}
GOLD, AUTO = [1406, 132, 80, 37, 32, 282], [1379, 107, 75, 41, 26, 254]


def test_published_margins(spark):
    from treeloom.operators import agreement

    n = lambda xs: spark.createDataFrame(list(zip(PATTERNS, xs, strict=True)), "pattern string, n long")
    m = {r.pattern: r for r in agreement.margins(spark.createDataFrame([(*k, v) for k, v in MATRIX.items()], "gold string, auto string, n long"), n(GOLD), n(AUTO)).collect()}
    assert sum(r.diagonal for r in m.values()) == 1780 and {p: r.off_diagonal for p, r in m.items() if r.off_diagonal} == {"OVS": 8}
    assert all(r.within for r in m.values()) and (m["SVO"].auto_aligned, m["OVS"].gold_aligned) == (1329, 246)


def test_reasons(spark):
    from treeloom.operators import agreement

    one = lambda *rows: spark.createDataFrame([(1, 1, sentence(*rows))], "doc_id long, line_no int, tokens array<struct<id:int,form:string,upos:string,head:int,deprel:string>>")
    gold = one((1, "s", "NOUN", 2, "nsubj"), (2, "v", "VERB", 0, "root"), (3, "o", "NOUN", 2, "obj"))
    auto = one((1, "s", "ADJ", 3, "nsubj"), (2, "v", "VERB", 0, "root"), (3, "o", "NOUN", 2, "obl"))
    inst = lambda s: M.match(s).select("doc_id", "line_no", F.col("s.id").alias("s"), F.col("v.id").alias("v"), F.col("o.id").alias("o"), "pattern")
    a = agreement.align(inst(gold), inst(auto))
    got = {r.reason: r.n for r in agreement.reasons(a, gold, auto).collect()}
    on = {"relevant_dependency_relation_differs", "object_relation_differs", "required_relation_retained_but_head_changes", "any_relevant_pos_mismatch", "subject_pos_mismatch"}
    assert got == {r: int(r in on) for r in agreement.REASONS}
    lost = {r.reason: r.n for r in agreement.reasons(a, gold, auto.where("line_no = 2")).collect()}
    assert lost == {r: int(r == agreement.REASONS[-1]) for r in agreement.REASONS}


def test_claims(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0], 4.0)], "v array<double>, t double")
    m = df.select(R.highest(F.col("v"), F.col("t")).alias("h"), R.lowest(F.col("v"), F.col("t")).alias("l"), R.more_than_half(F.col("v"), F.lit(2.5)).alias("m"), R.beyond_range(F.col("v"), F.col("t")).alias("r")).first()
    assert tuple(m) == (1.0, -3.0, 0.5, 2.0)
    rows = [("s", 1.0, 0.5), ("n", 1.0, 0.0), ("n", 1.0, 1.0), ("u", 0.0, 1.0), ("u", 1.0, -1.0), ("i", None, 1.0), ("i", 0.0, 0.0)]
    got = {r.k: (r.claims, r.verdict) for r in R.overall(spark.createDataFrame(rows, "k string, before double, after double"), "k").collect()}
    assert got == {"s": (1, "STABLE"), "n": (2, "NOT STABLE"), "u": (2, "UNRESOLVED"), "i": (2, "INCOMPLETE")}


def test_repetition(spark):
    cells = {p: 0 for p in PATTERNS}
    rows = [(1, "A", "OVS"), (2, "A", "OVS"), (3, "A", "SVO"), (4, "a", "OVS"), (5, "Z", None), (6, "Z", None)]
    df = spark.createDataFrame([(i, t, *(cells | ({p: 2 if p == "OVS" else 1} if p else {})).values()) for i, t, p in rows], "i long, t string, " + ", ".join(f"n_{p} long" for p in PATTERNS))
    assert sorted(r.i for r in R.first_occurrence(df, "t", "i").where("is_first").collect()) == [1, 4, 5]
    a = {r.t: r for r in R.audit(df, "t", "i").collect()}
    assert set(a) == {"A", "Z"} and (a["A"].occurrences, a["A"].mismatches, a["A"].excess_OVS, a["A"].excess_SVO, a["A"].nominal_OVS) == (3, 1, 2, 1, 4)
    both = R.counts_before_after(df, "t", "i").first()
    assert (both.before_OVS, both.after_OVS, both.before_SVO, both.after_SVO) == (6, 4, 1, 0)
    v = R.variants(df, "t", "i")
    assert sorted((r.t, r.occurrences, r.retained) for r in v.collect()) == [("A", 1, 0), ("A", 2, 1), ("Z", 2, 1)]
    assert '"retained_occurrences":1' in R.variants_json(v, "t").where("t = 'A'").first().variants
    keys = spark.createDataFrame([("x",), ("x ",), ("X",), ("x\t",), ("é",), ("é",), ("",)], "t string")
    assert R.repetition_counts(keys.withColumn("g", F.lit(1)), "t", "g").first().unique_n == 7


CONLLU = "# newdoc\n# text = Hi \n1\tA\ta\tNOUN\t_\t_\t2\tnsubj\t_\tNER=B-x\n2\tb\tb\tVERB\t_\t_\t0\troot\t_\t_\n\n# only comment\n\n1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\t_\tADP\t_\t_\t_\tcase\t_\t_\n1.1\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tl\t_\tDET\t_\t_\t1\tdet\t_\t_"


@pytest.mark.parametrize("plain,end,bom", [(False, "\n", ""), (False, "\r\n", "﻿"), (True, "\n", "")])
def test_conllu_reader(spark, tmp_path, plain, end, bom):
    path = tmp_path / "x.conllu"
    path.write_bytes((bom + CONLLU.replace("\n", end)).encode())
    got = conllu.read_conllu(spark, str(path), plain=plain).orderBy("ord").collect()
    assert [(r.text, r.is_fallback, [t.id for t in r.tokens], [t.head for t in r.tokens]) for r in got] == [("Hi ", False, [1, 2], [2, 0]), ("de l", True, [1, 2], [0, 1])]
    p = conllu.profile(spark, str(path)).first()
    assert (p.blocks, p.tokens, p.ner_tokens) == (3, 4, 1)
    assert [r.rule for r in conllu.violations(spark, str(path)).collect()] == ["head"]


def test_conllu_across_splits(spark, tmp_path):
    """Blocks are whole wherever a file is split."""
    rng = np.random.default_rng(5)
    blocks = [[f"{k}\tw{b}" for k in range(1, rng.integers(2, 9))] for b in range(300)]
    for name, end, sep in (("a.conllu", "\n", ["\n", "\n\n", " \t\n"]), ("b.conllu", "\r\n", ["\r\n", "\t\r\n\r\n"])):
        (tmp_path / name).write_bytes("".join(end.join(b) + end + str(rng.choice(sep)) for b in blocks).removesuffix(end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97b", "1k", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = conllu.blocks(spark, str(tmp_path / "*.conllu")).orderBy("file", "ord").collect()
        assert [r.lines for r in got] == blocks * 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "empty.conllu").write_text("\n\n")
    assert conllu.blocks(spark, str(tmp_path / "empty.conllu")).count() == 0


def test_conllu_strict_and_widths(spark, tmp_path):
    path = tmp_path / "x.conllu"
    path.write_text("# text = a\n# text = b\n" + "\t".join("1abcdef0hi") + "\n")
    assert conllu.read_conllu(spark, str(path)).first().text == "a"
    with pytest.raises(Exception, match="two texts"):
        conllu.read_conllu(spark, str(path), strict=True).collect()
    path.write_text("1\ta\tb\n\n" + "\t".join("1abcdef0hi") + "\n1\tZ" + "\t_" * 8 + "\n")
    b = conllu.blocks(spark, str(path)).orderBy("ord").select(conllu.wrong_width("lines").alias("w"), conllu.structural(F.col("lines")[0]).alias("s")).collect()
    assert [r.w for r in b] == [True, False] and len(b[1].s) == 9
    assert [[t.form for t in r.tokens] for r in conllu.read_conllu(spark, str(path)).orderBy("ord").collect()] == [[], ["Z"]]  # the last row of an id wins


def test_chunk_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 4)
    (tmp_path / "x.conllu").write_text("".join(f"{k}\tword\n\n" for k in range(10, 40)))
    b = conllu.blocks(spark, str(tmp_path / "x.conllu"))
    chunks = {r.lines[0]: r.chunk for r in conllu.chunk_ids(b, 24).collect()}  # blocks of 8 bytes
    assert chunks == {f"{k}\tword": (k - 10) // 3 for k in range(10, 40)}
    assert [r.chunk for r in conllu.chunk_ids(b, 17).orderBy("ord").collect()] == [k // 3 for k in range(30)]  # an excess counts for no other chunk
    conllu.write_chunks(b, str(tmp_path / "out"), 20)
    for c in range(10):
        (file,) = (tmp_path / "out" / "name=x" / f"chunk={c}").glob("part-*")
        assert file.read_text() == "".join(f"{k}\tword\n\n" for k in range(10 + 3 * c, 13 + 3 * c))


def test_greedy_chunks(spark, monkeypatch):
    """Against a loop: random sizes, rows larger than chunks, sizes of nought, gaps between places, null and single groups, no rows."""
    monkeypatch.setattr(ordered, "RANGE", 8)
    rng, rows, want = random.Random(8), [], {}
    kinds = [lambda: rng.randrange(1, 9), lambda: rng.choice([1, 2, 95]), lambda: rng.choice([0, 0, 7]), lambda: 10, lambda: 333]
    for g in [None, *range(14)]:
        kind, place, chunk, held = rng.choice(kinds), 0, 0, 0
        for _ in range(1 if g == 3 else rng.randrange(2, 90)):
            place += rng.randrange(1, 4)
            size = kind()
            rows.append((g, place, size))
            want[g, place] = chunk
            held += size
            if held >= 20:
                chunk, held = chunk + 1, 0
    df = spark.createDataFrame(rows, "g long, at int, size int")
    got = {(r.g, r.at): r.chunk for r in ordered.greedy_chunks(df.repartition(3), "g", F.col("at"), F.col("size"), 20).collect()}
    assert got == want
    assert ordered.greedy_chunks(df.limit(0), "g", F.col("at"), F.col("size"), 20).collect() == []


def plain_corpus(lines):
    """Genres in force, and blocks with the comments that waited for them, line by line."""
    genre, block, waiting, out = None, [], [], []

    def close():
        nonlocal block, waiting
        if block and all(x.startswith("#") for x in block):
            waiting += block
        elif block:
            out.append((genre, waiting + block))
            waiting = []
        block = []

    for line in [*lines, ""]:
        if not line.strip():
            close()
            continue
        block.append(line)
        if line.startswith("# newdoc"):
            genre = None
        elif line.startswith("# term ="):
            genre = next((g for mark, g in conllu.GENRES if mark in line), genre)
    return out


@pytest.mark.parametrize("size", [60, 200, 100_000])
def test_state_across_splits(spark, tmp_path, size):
    """Documents, terms and waiting comments that lie splits before what they hold for."""
    rng, want = random.Random(size), []
    for name in ("a", "b", "c"):
        lines = []
        for i in range(120):
            pick = rng.random()
            if pick < 0.1:
                lines += [f"# newdoc id = {i}", *[""] * rng.randrange(2)]
            elif pick < 0.25:
                lines += ["# term = zvrst / " + rng.choice(["umetnostna", "neumetnostna / strokovna", "druga"]), *["", " \t"][: rng.randrange(3)]]
            elif pick < 0.35:
                lines += [f"# c{i}"] * rng.randrange(1, 12) + [""]
            else:
                lines += [f"# sent_id = {name}{i}", f"1\t{name}{i}" + "\t_" * 8, *["# late"][: rng.randrange(2)], "", ""]
        ends = rng.choice(["\n", "\r\n"])
        (tmp_path / f"{name}.conllu").write_text(ends.join(lines) + rng.choice(["", ends]), newline="")
        want += [(name, i, g, b) for i, (g, b) in enumerate(plain_corpus(lines))]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        got = conllu.blocks(spark, str(tmp_path), genres=True, attach=True).orderBy("file", "ord").collect()
        sentences = conllu.read_conllu(spark, str(tmp_path), genres=True, attach=True).orderBy("file", "ord").collect()
    finally:
        spark.conf.set(key, before)
    seen = {}
    rows = [(n := r.file[-8], seen.setdefault(n, []).append(1) or len(seen[n]) - 1, r.genre, list(r.lines)) for r in got]
    assert rows == want
    assert [r.genre for r in sentences] == [g for _, _, g, _ in want]
    assert [len(r.comments) for r in sentences] == [sum(x.startswith("#") for x in b) for *_, b in want]


def test_cleaned_blocks(spark):
    """A root without a head is mended; any other head that is no number, or another width, drops the block."""
    row = lambda head, rel, feats="A=b", deps="1:x": "\t".join(["1", "w", "l", "X", "x", feats, head, rel, deps, "_"])
    cases = {"ok": [row("0", "root")], "mended": ["# c", row("_", "root", "Ncms", "x")], "word": [row("x", "root")], "none": [row("_", "obj")], "empty": [row("", "nsubj")], "wide": [row("0", "root") + "\t_"], "range": ["1-2" + row("_", "_")[1:]]}
    df = spark.createDataFrame([(k, 1, v) for k, v in cases.items()], "file string, ord int, lines array<string>")
    got = {r.file: None if r.dropped else list(r.lines) for r in conllu.cleaned(df).collect()}
    assert got == {**dict.fromkeys(["word", "none", "empty", "wide"]), "ok": cases["ok"], "mended": ["# c", row("0", "root", "_", "_")], "range": cases["range"]}


def test_shared_folder(spark):
    from types import SimpleNamespace

    from treeloom.sources import scratch

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(unset)
    path = scratch.own_folder(spark, "test")
    spark.range(3).write.parquet(path)
    assert scratch.exists(spark, path) and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.remove(spark, path)
    assert not scratch.exists(spark, path)


def test_conllu_round_trip_and_tagger(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    s = conllu.read_conllu(spark, str(tmp_path / "a.conllu"))
    tagged = conllu.annotate(s, lambda batch: [["B-x"] * len(x) for x in batch])
    conllu.write_conllu(tagged, str(tmp_path / "out"))
    again = conllu.read_conllu(spark, str(tmp_path / "out"))
    assert sorted(t.misc for r in again.collect() for t in r.tokens) == ["NER=B-x"] * 4
    with pytest.raises(Exception, match="doesn't match"):
        conllu.annotate(s, lambda batch: [[] for _ in batch]).collect()


def test_genres_and_pending(spark):
    df = spark.createDataFrame([("# term = zvrst / umetnostna / x",), ("# term = zvrst / neumetnostna / strokovna",), ("# term = y",)], "t string")
    assert [r.g for r in df.select(conllu.genre_of(F.col("t")).alias("g")).collect()] == ["leposlovno", "strokovno", None]
    rows = spark.createDataFrame([("d", 1, "c", True), ("d", 2, "s", False), ("d", 3, "c2", True)], "d string, i int, x string, p boolean")
    assert [(r.i, r.x, r.n_pending) for r in conllu.attach_pending(rows, F.col("p"), "x", ["d"], ["i"]).collect()] == [(2, "c\ns", 1)]


def test_tsv_contracts(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    files.write_tsv(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        files.write_tsv(df, str(tmp_path / "t"))
    assert sorted((r.k, r.v) for r in files.read_tsv(spark, str(tmp_path / "t"), ("k", "v")).collect()) == [("a", "1"), ("b", None)]
    with pytest.raises(ValueError, match="expected columns"):
        files.read_tsv(spark, str(tmp_path / "t"), ("k", "w"))
    (tmp_path / "dup.tsv").write_text("k\tv\na\t1\na\t2\n")
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.read_keyed_tsv(spark, str(tmp_path / "dup.tsv"), "k")
    digest = files.digests(spark, str(tmp_path / "dup.tsv")).first().sha256
    assert digest == hashlib.sha256((tmp_path / "dup.tsv").read_bytes()).hexdigest()
    assert files.streamed_digests(spark, str(tmp_path / "dup.tsv"), 3).first().sha256 == digest
    for bad in ("/x", "a/../b"):
        with pytest.raises(ValueError):
            files.inside("/base", bad)


def test_distribution_contract(spark):
    counts = spark.createDataFrame([("g", p, i + 1) for i, p in enumerate(PATTERNS)], "g string, pattern string, n long")
    good = D.zero_filled(counts, "g")
    assert distribution_violations(good, "g").count() == 0
    assert {r.rule for r in distribution_violations(good.where("pattern <> 'SVO'"), "g").collect()} == {"patterns", "sum"}
    grid = D.patterns_of(spark.createDataFrame([("g",)], "g string"))
    assert grid_violations(good, grid).count() == 0 and grid_violations(good.where("pattern <> 'SVO'"), grid).first().rule == "missing"

#: Published counts of four genres, and chi-square, seed and permutation p of four pairs.
PROFESSIONAL, PUBLICISTIC, LITERARY, SPOKEN = [831, 50, 46, 17, 20, 141], [2035, 193, 102, 51, 46, 410], [112, 8, 6, 4, 4, 28], [108, 18, 16, 4, 4, 18]
PUBLISHED = [
    (PROFESSIONAL, LITERARY, 20260715, 4.054349, 0.546773),
    (PROFESSIONAL, SPOKEN, 20260716, 22.788332, 0.000950),
    (PUBLICISTIC, LITERARY, 20260717, 2.823065, 0.724414),
    (PUBLICISTIC, SPOKEN, 20260718, 21.284946, 0.001800),
]


@pytest.mark.parametrize("a,b,seed,chi2,p", PUBLISHED)
def test_published_permutations(a, b, seed, chi2, p):
    table = np.array([a, b])
    assert round(I.chi_square_of(table), 6) == chi2
    assert round(I.permuted_labels(table, seed), 6) == p


def test_published_pairs_side_by_side(spark):
    rows = [(str(i), "x", a, b, seed) for i, (a, b, seed, _, _) in enumerate(PUBLISHED)]
    got = {r.group_a: (round(r.chi2, 6), round(r.p, 6)) for r in I.exact_pair_tests(spark.createDataFrame(rows, "group_a string, group_b string, a array<long>, b array<long>, seed long")).collect()}
    assert got == {str(i): x[3:] for i, x in enumerate(PUBLISHED)}


def test_published_distributions(spark):
    rows = [("professional", *PROFESSIONAL), ("publicistic", *PUBLICISTIC), ("literary", *LITERARY)]
    wide = spark.createDataFrame(rows, "g string, " + ", ".join(f"n_{p} long" for p in PATTERNS)).withColumn("total", sum(F.col(f"n_{p}") for p in PATTERNS))
    assert round(I.chi_square_of(np.array([r[1:] for r in rows])), 6) == 13.765731
    v = D.chi_square([F.col("a"), F.col("b")])
    got = {(r.group_a, r.group_b): round(r.v, 4) for r in D.pairs(wide, "g").select("group_a", "group_b", v["cramers_v"].alias("v")).collect()}
    assert got == {("literary", "professional"): 0.0566, ("literary", "publicistic"): 0.0307, ("professional", "publicistic"): 0.0524}
    assert {r.g: (r.dominant_order, r.dominant) for r in D.dominance(wide).collect()} == dict.fromkeys(("professional", "publicistic", "literary"), ("SVO", True))


def test_reports(spark, tmp_path):
    from treeloom.operators import reports

    df = spark.createDataFrame([(1, "I", "a_b", 1234.56), (2, "II", "c", None)], "row int, part string, name string, share double")
    tex = reports.latex_table(df, "part", "row", {"name": "Name", "share": "%"})
    assert r"a\_b & 1.234,6 \\" in tex and tex.count("multicolumn") == 2
    assert "a_b\t1234.56" in reports.text_report([("Top", df.select("name", "share"))])
    (tmp_path / "x").write_text("1")
    assert reports.checksum_list(files.digests(spark, str(tmp_path / "x"))).endswith("  x\n")
    assert reports.percentages_add_up(spark.createDataFrame([(50.0, 50.1), (50.0, 49.0)], "a double, b double"), ["a", "b"]).count() == 1


def test_splits_and_chunks(spark, tmp_path):
    for k, name in enumerate(("train", "dev", "test")):
        (tmp_path / f"x-{name}.conllu").write_text(f"{k}\ta\n\n{k}\tb\n")
    got = conllu.merge_splits(spark, str(tmp_path)).orderBy("split", "ord")
    assert [r.lines[0] for r in got.collect()] == ["0\ta", "0\tb", "1\ta", "1\tb", "2\ta", "2\tb"]
    one = got.withColumn("corpus", F.lit("x")).withColumn("ord", F.format_string("%d%s", "split", "ord"))
    assert [r.chunk for r in conllu.chunk_ids(one, 9, "corpus").orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1]  # blocks of 4 bytes
    (tmp_path / "y-dev.conllu").write_text("1\ta\n")
    with pytest.raises(ValueError, match="2 files"):
        conllu.merge_splits(spark, str(tmp_path))
