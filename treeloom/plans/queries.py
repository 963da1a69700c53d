"""The registered queries over the reference's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.special import chi2_tail, fisher_tail, sign_tail
from ..operators import agreement, distributions as D, inference as I, matching as M, repetition as R, resampling as S
from ..schema import PATTERNS, pattern_rank
from ..sources.scratch import staged
from ..sources.tables import dealt, load
from . import treebank

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")


def sents(spark: SparkSession, d: str) -> DataFrame:
    return treebank.sentences(docs(spark, d), "lang", "source")


def found(spark: SparkSession, d: str, what: M.TreeQuery = M.NOUNS) -> DataFrame:
    return M.match(sents(spark, d), what)


def counts(spark: SparkSession, d: str, *groups: str, what: M.TreeQuery = M.NOUNS) -> DataFrame:
    return M.order_counts(found(spark, d, what), *(groups or ("lang",)))


def wide(spark: SparkSession, d: str, group: str = "lang") -> DataFrame:
    return D.to_wide(counts(spark, d, group), group)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def pseudo_misc(t: Column) -> Column:
    first = F.substring(t["form"], 1, 1)
    named = (t["upos"] == "PROPN") & (first == F.upper(first)) & (first != F.lower(first))
    return F.when(named, "A=x|NER=B-x").otherwise("NER=O")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Six counts of every sentence with its text; each third document's SVO count is blanked, so that parses differ."""
    out = M.count_in_row(treebank.sentences(docs(spark, d), "lang", text=True))
    return out.withColumn("n_SVO", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("n_SVO")))


def perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Sentences in which some subjects and objects have changed places, some tags differ and some heads are lost."""

    def change(t: Column) -> Column:
        key = F.col("doc_id") + t["id"]
        rel = F.when((key % 97 == 0) & (t["deprel"] == "nsubj"), "obj").when((key % 97 == 0) & (t["deprel"] == "obj"), "nsubj").otherwise(t["deprel"])
        upos, head = F.when(key % 89 == 0, "ADJ").otherwise(t["upos"]), F.when(key % 83 == 0, 0).otherwise(t["head"])
        return F.struct(t["id"].alias("id"), t["form"].alias("form"), upos.alias("upos"), head.alias("head"), rel.alias("deprel"))

    return sents(spark, d).withColumn("tokens", F.transform("tokens", change))


def flat(instances: DataFrame) -> DataFrame:
    return instances.select("doc_id", "line_no", F.col("s.id").alias("s"), F.col("v.id").alias("v"), F.col("o.id").alias("o"), "pattern")


@query
def token_scan_profile(spark, d):
    t = sents(spark, d)
    return t.groupBy("lang").agg(
        F.count_if(F.size("tokens") > 0).alias("n_sentences"),
        F.sum(F.size("tokens")).cast("long").alias("n_tokens"),
        F.sum(F.size(F.filter("tokens", lambda x: x["upos"] == "VERB"))).cast("long").alias("n_verbs"),
        F.sum(F.size(F.filter("tokens", lambda x: x["deprel"] == "root"))).cast("long").alias("n_roots"),
    )


@query
def order_counts_noun(spark, d):
    return counts(spark, d)


@query
def order_counts_noun_propn(spark, d):
    return counts(spark, d, what=M.NOUNS_AND_NAMES)


@query
def order_counts_broad(spark, d):
    return counts(spark, d, what=M.TreeQuery.parse("upos=VERB >nsubj _ >obj _"))


@query
def order_counts_zero_filled(spark, d):
    small = M.order_counts(found(spark, d).where("pattern <> 'OSV'"), "source")
    return D.zero_filled(small, "source").withColumn("proportion", r6("proportion"))


@query
def order_summary_wide(spark, d):
    w = D.dominance(wide(spark, d))
    shares = [r6(F.col(f"n_{p}") / F.col("total")).alias(f"p_{p}") for p in PATTERNS]
    return w.select("lang", "total", *[f"n_{p}" for p in PATTERNS], *shares, r6("entropy").alias("entropy"), "dominant_order", "dominant", r6("top_ratio").alias("top_ratio"))


@query
def two_engine_reconcile(spark, d):
    s = sents(spark, d)
    a = M.order_counts(M.match(s), "lang").withColumnRenamed("n", "n_row")
    b = M.order_counts(M.match_by_join(s), "lang").withColumnRenamed("n", "n_join")
    return a.join(b, ["lang", "pattern"], "full_outer").withColumn("agree", F.col("n_row").eqNullSafe(F.col("n_join")))


@query
def cache_fallback_status(spark, d):
    w = wide(spark, d).select("lang", "total")
    fresh = w.where("lang in ('en', 'de')").withColumnRenamed("total", "fresh")
    cached = w.where("lang in ('de', 'fr')").withColumnRenamed("total", "cached")
    manifest = docs(spark, d).select("lang").distinct()
    status = F.when(F.col("fresh").isNotNull(), "prepared").when(F.col("cached").isNotNull(), "cached").otherwise("missing")
    return manifest.join(fresh, "lang", "left").join(cached, "lang", "left").select("lang", F.coalesce("fresh", "cached").alias("total"), status.alias("status"))


@query
def tree_string_classify(spark, d):
    i = found(spark, d)
    word = lambda c: F.concat(F.lit("w"), F.col(f"{c}.id").cast("string"))
    v, rel = word("v"), {"S": "nsubj", "O": "obj"}

    def written(p: str) -> Column:
        at, parts = p.index("V"), []
        for k, x in enumerate(p):
            w = v if x == "V" else word(x.lower())
            parts.append(w if x == "V" else F.concat(w, F.lit(f" <{rel[x]}")) if k < at else F.concat(F.lit(f">{rel[x]} "), w))
        return F.concat_ws(" ", *parts)

    tree = F.coalesce(*[F.when(F.col("pattern") == p, written(p)) for p in PATTERNS])
    trees = i.select(tree.alias("tree")).union(sents(spark, d).select(F.lit("w1 >nsubj w2")))
    tally = trees.groupBy("tree").agg(F.count("*").alias("frequency"))
    return tally.groupBy(M.classify_linear(F.col("tree")).alias("pattern")).agg(F.sum("frequency").alias("n"))


@query
def dual_role_ner_counts(spark, d):
    return M.dual_roles(found(spark, d, M.NOUNS_AND_NAMES), lambda t: M.ner_status(pseudo_misc(t)), "lang")


@query
def misc_upsert(spark, d):
    t = sents(spark, d).select("lang", F.explode("tokens").alias("t"))
    old = pseudo_misc(F.col("t"))
    return t.select("lang", M.misc_upsert(old, F.col("t.upos")).alias("misc")).groupBy("lang", "misc").agg(F.count("*").alias("n"))


@query
def root_repair_and_drop(spark, d):
    from ..sources.conllu import repair_roots, unattached

    key = F.col("doc_id") + F.col("line_no")

    def spoil(t: Column) -> Column:
        lost = ((key % 11 == 0) & (t["deprel"] == "root")) | ((key % 13 == 0) & (t["deprel"] != "root") & (t["id"] % 7 == 0))
        return F.struct(t["id"].alias("id"), F.when(lost, "_").otherwise(t["head"].cast("string")).alias("head"), t["deprel"].alias("deprel"))

    s = sents(spark, d).withColumn("tokens", F.transform("tokens", spoil))
    s = s.withColumn("repaired", F.size(F.filter("tokens", lambda t: (t["head"] == "_") & (t["deprel"] == "root")))).withColumn("tokens", repair_roots("tokens"))
    bad = unattached("tokens")
    return s.groupBy("lang").agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"), F.sum(F.when(~bad, F.col("repaired")).otherwise(0)).cast("long").alias("repaired"))


@query
def genre_carry_forward(spark, d):
    from ..sources.conllu import carry_forward

    c = load(spark, d, "conversations")
    mark = F.when((F.col("role") == "user") & (F.length("text") % 3 == 0), "a").when((F.col("role") == "user") & (F.length("text") % 3 == 1), "b")
    return carry_forward(c.withColumn("mark", mark), F.col("role") == "system", "mark", "genre", ["conv_id"], ["turn"]).select("conv_id", "turn", "genre")


@query
def comment_attach(spark, d):
    from ..sources.conllu import attach_pending

    c = load(spark, d, "conversations")
    out = attach_pending(c, F.col("role") == "system", "text", ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), "n_pending")


def _pairs(spark, d):
    return D.pairs(wide(spark, d), "lang")


@query
def pairwise_chi2(spark, d):
    x = D.chi_square([F.col("a"), F.col("b")])
    return _pairs(spark, d).select("group_a", "group_b", r6(x["chi2"]).alias("chi2"), x["df"].cast("long").alias("df"), r6(x["min_expected"]).alias("min_expected"), x["n_small"].cast("long").alias("n_small"), r6(x["cramers_v"]).alias("cramers_v"))


@query
def pairwise_jsd(spark, d):
    return _pairs(spark, d).select("group_a", "group_b", r6(D.jensen_shannon(D.shares_of(F.col("a")), D.shares_of(F.col("b")))).alias("jsd"))


@query
def pairwise_cosine(spark, d):
    return _pairs(spark, d).select("group_a", "group_b", r6(D.cosine(D.shares_of(F.col("a")), D.shares_of(F.col("b")))).alias("cosine"))


@query
def omnibus_chi2(spark, d):
    c = counts(spark, d)
    chi = I.table_chi2(c.withColumn("k", F.lit(1)), ["k"], "lang", "pattern")
    size = c.agg(F.sum("n").alias("n"), F.count_distinct("lang").alias("r"), F.count_distinct("pattern").alias("c"))
    return chi.crossJoin(size).select(r6("chi2").alias("chi2"), "n", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"))  # one row by one row


@query
def cramers_v(spark, d):
    e = load(spark, d, "events").select(F.lit("events").alias("name"), F.col("event_type").alias("x"), (F.col("user_id") % 5).cast("string").alias("y"))
    o = load(spark, d, "orders").select(F.lit("orders").alias("name"), F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("y"))
    cells = e.union(o).groupBy("name", "x", "y").agg(F.count("*").alias("n"))
    size = cells.groupBy("name").agg(F.sum("n").alias("n"), F.least(F.count_distinct("x"), F.count_distinct("y")).alias("k"))
    return I.table_chi2(cells, ["name"], "x", "y").join(size, "name").select("name", "n", r6("chi2").alias("chi2"), r6(F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1)))).alias("v"))


@query
def chi2_pvalue(spark, d):
    x = D.chi_square([F.col("a"), F.col("b")])
    return _pairs(spark, d).select("group_a", "group_b", r6(chi2_tail(x["chi2"], x["df"].cast("double"))).alias("p"))


@query
def holm_adjust(spark, d):
    p = D.zero_filled(counts(spark, d), "lang").select("lang", "pattern", F.round(F.col("proportion") / 10, 6).alias("p"))
    return D.holm(p, "lang", "pattern").select("lang", "pattern", "p", r6("p_holm").alias("p_holm"))


@query
def fisher_2x2(spark, d):
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    t = load(spark, d, "labels").agg(n(0, 0).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(1, 1).alias("e"))
    return t.select("a", "b", "c", "e", r6(F.col("a") * F.col("e") / (F.col("b") * F.col("c"))).alias("odds_ratio"), r6(fisher_tail("a", "b", "c", "e")).alias("p"))


#: Replicates of the permutations by hash, which order every unit in each and which SQL repeats in full; the others have REPLICATES.
HASHED = 1000


def _perm(statistics, *by):
    return I.permutation_p(statistics, "chi2", *by).select(*by, r6("chi2").alias("chi2"), "hits", "replicates", r6("p").alias("p"))


@query
def perm_chi2_hash(spark, d):
    units = dealt(staged(load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "units"))
    drawn = I.hash_permuted(units, "doc_id", "quality", HASHED)
    cells = staged(drawn.groupBy("replicate", "drawn", "toxic").agg(F.count("*").alias("n")), "cells")
    return _perm(I.table_chi2(cells, ["replicate"], "drawn", "toxic"))


def clusters(spark, d, *groups: str) -> DataFrame:
    """The six counts of every document that has instances."""
    per = M.count_in_row(treebank.sentences(docs(spark, d), *groups)).groupBy("doc_id", *groups).agg(*[F.sum(f"n_{p}").alias(f"n_{p}") for p in PATTERNS])
    return per.where(sum((F.col(f"n_{p}") for p in PATTERNS), F.lit(0)) > 0)


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n_{p}").alias("n")) for p in PATTERNS])))


@query
def cluster_perm_hash(spark, d):
    """Documents of each two languages, permuted whole."""
    langs = docs(spark, d).agg(F.collect_set("lang").alias("langs"))  # one row
    pair = F.explode(F.transform(F.filter("langs", lambda x: x != F.col("lang")), lambda x: F.struct(F.least("lang", x).alias("group_a"), F.greatest("lang", x).alias("group_b"))))
    units = dealt(staged(clusters(spark, d, "lang"), "units")).crossJoin(F.broadcast(langs)).select("*", pair.alias("pair")).select("doc_id", "lang", "pair.*", *[f"n_{p}" for p in PATTERNS])
    drawn = I.hash_permuted(units, "doc_id", "lang", 200, by=("group_a", "group_b"))
    keys = ["group_a", "group_b", "replicate"]
    cells = staged(drawn.groupBy(*keys, "drawn").agg(*[F.sum(f"n_{p}").alias(f"n_{p}") for p in PATTERNS]), "cells")
    return _perm(I.table_chi2(_long(cells, *keys, "drawn"), keys, "drawn", "pattern"), "group_a", "group_b")


def _sides(spark, d):
    c = load(spark, d, "conversations").where("role in ('user', 'assistant')")
    return c.groupBy("conv_id").agg(
        *[F.count_if((F.col("role") == r) & (F.length("text") % 2 == k)).alias(f"{r[0]}{k}") for r in ("user", "assistant") for k in (0, 1)],
        *[F.coalesce(F.sum(F.when(F.col("role") == r, F.length("text"))), F.lit(0)).cast("long").alias(f"{r}_len") for r in ("user", "assistant")],
    )


@query
def paired_swap_hash(spark, d):
    """Both sides of every conversation change places by bits of a counter-based generator, REPLICATES times."""
    t = S.swapped_sums(_sides(spark, d), "conv_id", ["u0", "u1"], ["a0", "a1"], [])
    two = lambda x: F.array(F.col(f"{x}0").cast("double"), F.col(f"{x}1").cast("double"))
    return _perm(t.select("replicate", D.chi_square([two("u"), two("a")])["chi2"].alias("chi2")))


@query
def bootstrap_ci_hash(spark, d):
    """Intervals of SVO share and entropy over documents taken by a counter-based generator, REPLICATES times."""
    b = S.bootstrap_sums(clusters(spark, d, "lang"), "doc_id", [f"n_{p}" for p in PATTERNS], ["lang"])
    total = sum((F.col(f"n_{p}") for p in PATTERNS), F.lit(0))
    b = b.where(total > 0).select("lang", (F.col("n_SVO") / total).alias("svo"), D.entropy(D.shares_of(D.vector())).alias("entropy"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return b.groupBy("lang").agg(q("svo").alias("s"), q("entropy").alias("e")).select("lang", *[r6(F.get(c, F.lit(i))).alias(f"{n}_{x}") for c, n in (("s", "svo"), ("e", "entropy")) for i, x in ((0, "lo"), (1, "hi"))])


#: The seeds of the count-level and cluster permutations.
COUNT_SEED, CLUSTER_SEED = 20260715, 20260828


def _families(spark, d) -> DataFrame:
    """``(family, lang)``: each two languages, and all of them."""
    langs = docs(spark, d).where("lang is not null").select("lang").distinct()
    other = langs.withColumnRenamed("lang", "other")
    two = langs.join(F.broadcast(other), F.col("lang") < F.col("other"))  # languages
    name = F.concat_ws("-", "lang", "other")
    return two.select(name.alias("family"), "lang").union(two.select(name, "other")).union(langs.select(F.lit("all"), "lang"))


@query
def perm_chi2_counts(spark, d):
    """Order counts of each two languages, and of all, under shuffled labels."""
    v = wide(spark, d).select("lang", F.array(*[F.col(f"n_{p}") for p in PATTERNS]).alias("v"))
    tables = _families(spark, d).join(v, "lang").groupBy("family").agg(F.sort_array(F.collect_list(F.struct("lang", "v"))).alias("x"))  # languages
    out = S.count_permutations(tables.select("family", F.col("x.v").alias("cells")), ["family"], "cells", COUNT_SEED)
    return out.select("family", r6("chi2").alias("chi2"), "hits", "replicates", r6("p").alias("p"))


@query
def cluster_perm(spark, d):
    """Whole documents of each two languages, and of all, dealt to the languages anew."""
    names = [f"n_{p}" for p in PATTERNS]
    units = clusters(spark, d, "lang").join(F.broadcast(_families(spark, d)), "lang")  # a few rows of families
    t = S.permuted_sums(units.select("family", "doc_id", "lang", *names), "doc_id", names, ["family"], "lang", CLUSTER_SEED)
    return _perm(S.table_statistics(t, ["family", "replicate"], names), "family")


@query
def sign_test(spark, d):
    x = _sides(spark, d).where("user_len > 0 and assistant_len > 0 and user_len <> assistant_len")
    t = x.agg(F.count_if(F.col("user_len") > F.col("assistant_len")).alias("positive"), F.count("*").alias("n"))
    return t.select("positive", "n", r6(sign_tail("positive", "n")).alias("p"))


@query
def wilcoxon_w(spark, d):
    x = _sides(spark, d).where("user_len > 0 and assistant_len > 0").select(F.lit("all").alias("g"), (F.col("user_len") - F.col("assistant_len")).alias("d"))
    mean = x.agg(r6(F.avg("d")).alias("mean_difference"))
    return I.signed_ranks(x, "g", "d").crossJoin(mean).select("n", "w_plus", "w_minus", "w", "mean_difference")  # one row by one row


@query
def wilcoxon_p(spark, d):
    x = _sides(spark, d).where("user_len > 0 and assistant_len > 0").select(F.lit("all").alias("g"), (F.col("user_len") - F.col("assistant_len")).cast("double").alias("d"))
    return I.wilcoxon_p(x, "g", "d").select("g", r6("w").alias("w"), r6("p").alias("p"))


@query
def exact_dedup_counts(spark, d):
    texts = docs(spark, d).select(F.lit("text").alias("unit"), "lang", F.col("text").alias("identity"))
    lines = docs(spark, d).select(F.lit("line"), "lang", F.explode(F.split("text", "\n")))
    return R.repetition_counts(texts.union(lines), "identity", "unit", "lang").withColumn("pct", r6("pct"))


def _before_after(spark, d):
    """One scan and one shuffle of the sentences: an identity's counts and those of its first occurrence come together."""
    per = M.count_in_row(treebank.sentences(docs(spark, d), "lang", text=True))
    both = R.counts_before_after(per, "line", "doc_id", "line_no", scope=("lang",))
    vec = lambda w: F.array(*[F.col(f"{w}_{p}").cast("double") for p in PATTERNS])
    total = lambda w: sum((F.col(f"{w}_{p}") for p in PATTERNS), F.lit(0)).cast("long")
    out = both.select("lang", vec("before").alias("before"), total("before").alias("total_before"), vec("after").alias("after"), total("after").alias("total_after"))
    return out.where("total_before > 0").select("lang", "total_before", "total_after", "before", F.when(F.col("total_after") > 0, F.col("after")).otherwise(F.col("before")).alias("after"))


@query
def dedup_before_after(spark, d):
    p, q = D.shares_of(F.col("before")), D.shares_of(F.col("after"))
    return _before_after(spark, d).select(
        "lang", "total_before", "total_after", r6(100 * F.abs(F.get(q, F.lit(0)) - F.get(p, F.lit(0)))).alias("svo_pp"), r6(F.abs(D.entropy(q) - D.entropy(p))).alias("entropy_change"), r6(D.jensen_shannon(p, q)).alias("jsd")
    )


def _audit(spark, d):
    return R.audit(sentence_vectors(spark, d), "line", "doc_id", "line_no")


@query
def duplicate_audit(spark, d):
    a = _audit(spark, d)
    return a.select("line", "occurrences", "variants", "mismatches", F.col("first_at.doc_id").alias("first_doc"), F.col("first_at.line_no").cast("long").alias("first_line"), "excess", *[c for p in PATTERNS for c in (f"excess_{p}", f"nominal_{p}")])


@query
def duplicate_variants(spark, d):
    v = R.variants(sentence_vectors(spark, d), "line", "doc_id", "line_no")
    return v.select("line", "occurrences", "retained", *[F.get("vector", F.lit(i)).alias(f"n_{p}") for i, p in enumerate(PATTERNS)])


@query
def duplicate_variants_json(spark, d):
    return R.variants_json(R.variants(sentence_vectors(spark, d), "line", "doc_id", "line_no"), "line")


@query
def duplicate_examples(spark, d):
    """The export of repeated sentences of each language, numbered as they stand there; every seventh document's have no text of their own."""
    from ..operators.ordered import running_sums

    v = sentence_vectors(spark, d).withColumn("lang", F.coalesce("lang", F.lit("")))
    place = F.col("doc_id") * (1 << 20) + F.col("line_no")
    numbered = running_sums(v, "lang", place, before=F.lit(1)).withColumn("index", F.col("before") + 1).withColumn("is_fallback", F.col("doc_id") % 7 == 0)
    keyed = numbered.withColumn("identity", F.concat_ws("\t", "lang", "line"))
    return R.examples(keyed, "identity", "index", "is_fallback")


@query
def repetition_with_fallbacks(spark, d):
    """Sentences, distinct ones, repeats and made-up identities by language."""
    x = sentence_vectors(spark, d).withColumn("is_fallback", F.col("doc_id") % 7 == 0)
    return R.repetition_counts(x, "line", "lang", fallback="is_fallback").withColumn("pct", r6("pct"))


@query
def topk_excess(spark, d):
    a = _audit(spark, d).where("excess > 0")
    return a.orderBy(F.desc("excess"), "first_at").limit(30).select("line", "excess", "occurrences")


@query
def topk_rankings(spark, d):
    """The thirty identities that hold most by each of three measures; ties go to the first occurrence."""
    return R.rankings(_audit(spark, d), ("excess", "excess_OVS", "excess_SVO"), "line", 30)


@query
def concentration(spark, d):
    return R.concentration(_audit(spark, d), 5, 10, 20).withColumn("share", r6("share"))


def _margins(spark, d):
    ba = _before_after(spark, d)
    share = lambda c: F.get(c, F.lit(0)) / F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    x = ba.select("lang", share(F.col("before")).alias("b"), share(F.col("after")).alias("a"))
    rows = x.agg(F.collect_list(F.struct("lang", "b", "a")).alias("all"))  # a few groups
    each = rows.select("all", F.explode("all").alias("t"))
    rest = F.filter("all", lambda o: o["lang"] != F.col("t.lang"))
    top = lambda c: F.array_max(F.transform(rest, lambda o: o[c]))
    low = lambda c: F.array_min(F.transform(rest, lambda o: o[c]))
    return each.select(
        F.col("t.lang").alias("lang"),
        F.inline(F.array(F.struct(F.lit("highest").alias("claim"), (F.col("t.b") - top("b")).alias("before"), (F.col("t.a") - top("a")).alias("after")), F.struct(F.lit("lowest").alias("claim"), (low("b") - F.col("t.b")).alias("before"), (low("a") - F.col("t.a")).alias("after")))),
    )


@query
def claim_margins(spark, d):
    return _margins(spark, d).select("lang", "claim", r6("before").alias("before"), r6("after").alias("after"))


@query
def claim_verdicts(spark, d):
    return _margins(spark, d).select("lang", "claim", R.verdict(F.col("before"), F.col("after")).alias("verdict"))


def _claims(spark, d):
    """Claims of three more kinds: one language's share exceeds another's; that of more than half of the others; by more than their range."""
    share = lambda c: F.get(c, F.lit(0)) / F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = _before_after(spark, d).agg(F.collect_list(F.struct("lang", share(F.col("before")).alias("b"), share(F.col("after")).alias("a"))).alias("all"))  # a few groups
    one = rows.select("all", F.explode("all").alias("x"))
    two = one.select("all", "x", F.explode("all").alias("y")).where(F.col("x.lang") < F.col("y.lang"))
    others = lambda w, *not_: F.transform(F.filter("all", lambda o: ~o["lang"].isin(*[F.col(f"{n}.lang") for n in not_])), lambda o: o[w])
    gap = lambda w: F.col(f"x.{w}") - F.col(f"y.{w}")
    none = F.lit(None).cast("string")
    most = one.select(F.lit("majority").alias("kind"), F.col("x.lang").alias("one"), none.alias("other"), *[R.more_than_half(others(w, "x"), F.col(f"x.{w}")).alias(n) for w, n in (("b", "before"), ("a", "after"))])
    pair = lambda kind, margin: two.select(F.lit(kind), F.col("x.lang"), F.col("y.lang"), margin("b"), margin("a"))
    return most.union(pair("direction", gap)).union(pair("range", lambda w: R.beyond_range(others(w, "x", "y"), gap(w))))


@query
def claim_checks(spark, d):
    return _claims(spark, d).select("kind", "one", "other", r6("before").alias("before"), r6("after").alias("after"))


@query
def claim_overall(spark, d):
    return R.overall(_claims(spark, d), "kind")


def _catalogue(spark, d):
    """``(claims, long)``: all kinds of claims over the languages there are, and their measures before and after removing repeats."""
    from ..operators import claims as C

    long = C.measures(_before_after(spark, d).select("lang", "before", "after"), "lang")
    names = sorted(r[0] for r in docs(spark, d).where("lang is not null").select("lang").distinct().collect())  # languages, not rows
    made = [c for n in names for c in (C.dominant(f"{n}: dominant", n), C.highest(f"{n}: most OVS", "share_OVS", n, names), C.lowest(f"{n}: least entropy", "entropy", n, names), C.above_majority(f"{n}: entropy above most", "entropy", n, names))]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            rest = [n for n in names if n not in (a, b)]
            made += [C.exceeds(f"{a} > {b}: entropy", "entropy", a, b), C.closer_to_majority(f"{a} < {b}: distance", a, b, names), C.gap_beyond_range(f"{a} - {b}: SVO beyond range", "share_SVO", a, b, rest)]
    made.append(C.exceeds("xx > en: entropy", "entropy", "xx", "en"))  # a group that isn't there
    return C.catalogue(spark, made).union(C.nearest_sets(long, 2)), long


@query
def claim_catalogue(spark, d):
    """Margins and verdicts of a catalogue of claims: extremes, dominance, directions, majorities, ranges, and nearest and farthest sets."""
    from ..operators import claims as C

    return C.judged(*_catalogue(spark, d)).select("label", "kind", r6("before").alias("before"), r6("after").alias("after"), R.verdict(r6("before"), r6("after")).alias("verdict"))


@query
def claim_catalogue_overall(spark, d):
    from ..operators import claims as C

    return R.overall(C.judged(*_catalogue(spark, d)).select("kind", r6("before").alias("before"), r6("after").alias("after")), "kind")


def _aligned(spark, d):
    return agreement.align(flat(found(spark, d)), flat(M.match(perturbed(spark, d))))


@query
def agreement_matrix(spark, d):
    return agreement.matrix(_aligned(spark, d))


@query
def agreement_rates(spark, d):
    out = agreement.rates(_aligned(spark, d))
    return out.select(*agreement.KINDS, "unclear_gold", "unclear_auto", "gold_n", "auto_n", "aligned", "to_review", *[r6(c).alias(c) for c in ("recall", "same_among_aligned", "changed_or_lost")])


@query
def agreement_margins(spark, d):
    by = lambda i: M.order_counts(i)
    return agreement.margins(agreement_matrix(spark, d), by(found(spark, d)), by(M.match(perturbed(spark, d))))


@query
def agreement_reasons(spark, d):
    return agreement.reasons(_aligned(spark, d), sents(spark, d), perturbed(spark, d)).withColumn("pct", r6("pct"))


@query
def contract_violations(spark, d):
    from ..operators.contracts import distribution_violations

    rows = D.zero_filled(counts(spark, d), "lang")
    spoilt = rows.where("not (lang = 'fr' and pattern = 'VSO')").withColumn("n", F.when((F.col("lang") == "de") & (F.col("pattern") == "SVO"), F.col("n") + 1).otherwise(F.col("n")))
    return distribution_violations(spoilt, "lang")


@query
def master_table(spark, d):
    w = D.dominance(wide(spark, d))
    pct = [F.round((F.col(f"n_{p}") * 100).cast("decimal(28,10)") / F.col("total"), 1).cast("double").alias(f"pct_{p}") for p in PATTERNS]
    place = F.row_number().over(Window.orderBy("lang")).cast("long")
    return w.select(place.alias("row"), "lang", "total", *pct, F.round(F.round("entropy", 6).cast("decimal(18,6)"), 2).cast("double").alias("entropy"), F.when(F.col("dominant"), F.col("dominant_order")).otherwise("none").alias("note"))


@query
def register_sorted(spark, d):
    w = wide(spark, d, "source")
    place = F.row_number().over(Window.orderBy(F.desc("svo"), "source")).cast("long")
    return w.select("source", r6(F.col("n_SVO") / F.col("total")).alias("svo")).select("source", "svo", place.alias("place"))


@query
def jsd_matrix(spark, d):
    """The lower triangle in long form, whatever languages there are: row, column, and the places of both in the matrix."""
    langs = docs(spark, d).agg(F.sort_array(F.collect_set("lang")).alias("langs"))  # one row
    place = lambda c: F.array_position("langs", F.col(c)).cast("long")
    x = pairwise_jsd(spark, d).crossJoin(F.broadcast(langs))
    return x.select(F.col("group_b").alias("row_lang"), F.col("group_a").alias("column_lang"), place("group_b").alias("row"), place("group_a").alias("column"), "jsd")


@query
def share_entropy_union(spark, d):
    one = lambda g, kind: D.dominance(wide(spark, d, g)).select(F.lit(kind).alias("kind"), F.col(g).alias("name"), r6(F.col("n_SVO") / F.col("total")).alias("svo"), r6("entropy").alias("entropy"))
    return one("lang", "language").unionByName(one("source", "register"))


@query
def set_checks(spark, d):
    x = docs(spark, d)
    a, b = x.where("lang = 'en'").select("source").distinct(), x.where("lang in ('de', 'es')").select("source").distinct()
    one = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    return one(a.exceptAll(b).union(b.exceptAll(a)), "symmetric_difference").union(one(a.join(b, "source", "left_anti"), "not_in_second")).union(one(a.where("source <> 'src0'"), "without_target")).union(one(a.intersect(b), "shared"))


@query
def file_digest(spark, d):
    from ..sources.files import digests

    return digests(spark, f"{d}/nation.parquet")


SELECTED = (("en", "de"), ("fr", "en"), ("es", "fr"))


@query
def manifest_pair_join(spark, d):
    w = wide(spark, d).select("lang", "total")
    picked = spark.createDataFrame([(i, a, b, sorted((a, b))) for i, (a, b) in enumerate(SELECTED)], "ord int, a string, b string, key array<string>")
    both = picked.join(w.select(F.col("lang").alias("a"), F.col("total").alias("total_a")), "a").join(w.select(F.col("lang").alias("b"), F.col("total").alias("total_b")), "b")
    wanted = spark.createDataFrame([(["de", "en"],), (["es", "fr"],)], "key array<string>")
    members = both.join(wanted, "key", "left_semi").select(F.col("ord").alias("ord_in"), F.lit(True).alias("in_family"))
    return both.join(members, both.ord == members.ord_in, "left").select(F.col("ord").cast("long").alias("ord"), "a", "b", "total_a", "total_b", F.coalesce("in_family", F.lit(False)).alias("in_family"))


@query
def pair_alignment(spark, d):
    c = load(spark, d, "conversations").where("role in ('user', 'assistant')")
    p = c.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.count(F.lit(1)))
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    return p.select("conv_id", n("user").alias("n_user"), n("assistant").alias("n_assistant"), ((n("user") > 0) & (n("assistant") > 0)).alias("complete"), ((n("user") > 0) | (n("assistant") > 0)).alias("informative"))


LAYOUT = (("I", "en", "English"), ("I", "de", "German"), ("II", "fr", "French"), ("II", "es", "Spanish"), ("III", "xx", "None"))


@query
def layout_join_checked(spark, d):
    spec = spark.createDataFrame([(i, *x) for i, x in enumerate(LAYOUT)], "ord int, section string, lang string, label string")
    j = spec.join(wide(spark, d).select("lang", "total"), "lang", "full_outer")
    order = Window.orderBy("ord")
    return j.select(F.row_number().over(order).cast("long").alias("row"), "section", "lang", "label", "total", (~F.col("section").eqNullSafe(F.lag("section").over(order))).alias("new_section"), (F.col("ord").isNull() | F.col("total").isNull()).alias("unmatched"))


@query
def positional_diff(spark, d):
    rows = lambda s: s.select("doc_id", "line_no", F.posexplode("tokens").alias("at", "t"))
    a, b = rows(sents(spark, d)), rows(perturbed(spark, d))
    b = b.withColumnRenamed("t", "u")
    j = a.join(b, ["doc_id", "line_no", "at"], "full_outer")
    return j.where(~F.col("t").eqNullSafe(F.col("u"))).groupBy(F.col("t.deprel").alias("was"), F.col("u.deprel").alias("now")).agg(F.count("*").alias("n"))


@query
def cluster_vectors(spark, d):
    per = clusters(spark, d, "lang")
    summed = per.groupBy("lang").agg(F.count("*").alias("clusters"), *[F.sum(f"n_{p}").alias(f"s_{p}") for p in PATTERNS])
    total = wide(spark, d)
    return summed.join(total, "lang").select("lang", "clusters", *[f"s_{p}" for p in PATTERNS], F.forall(F.array(*[F.col(f"s_{p}") == F.col(f"n_{p}") for p in PATTERNS]), lambda x: x).alias("agrees"))


@query
def ner_role_sum(spark, d):
    roles = dual_role_ner_counts(spark, d).groupBy("lang", "role", "pattern").agg(F.sum("n").alias("n"))
    whole = counts(spark, d, what=M.NOUNS_AND_NAMES).withColumnRenamed("n", "expected")
    return roles.join(whole, ["lang", "pattern"], "full_outer").select("lang", "role", "pattern", "n", F.col("n").eqNullSafe(F.col("expected")).alias("agrees"))


@query
def variant_left_join(spark, d):
    """Repeated types with their variants, and how many break the accounting of occurrences and retained copies."""
    from ..operators.contracts import repetition_violations

    a = _audit(spark, d).select("line", "occurrences", "mismatches")
    v = R.variants(sentence_vectors(spark, d), "line", "doc_id", "line_no")
    sums = a.agg(F.count("*").alias("identities"), F.sum("occurrences").alias("occurrences"), F.count_if(F.col("mismatches") > 0).alias("with_mismatch"))
    return sums.crossJoin(repetition_violations(a, v, "line").agg(F.count("*").alias("violations")))  # one row by one row


@query
def share_datasets(spark, d):
    c = D.zero_filled(counts(spark, d), "lang").select(F.lit("order").alias("dataset"), F.col("lang").alias("name"), "pattern", r6(100 * F.col("proportion")).alias("pct"))
    e = dual_role_ner_counts(spark, d).where("role = 'object'").groupBy("status", "pattern").agg(F.sum("n").alias("n"))
    e = e.select(F.lit("status"), "status", "pattern", r6(100 * F.col("n") / F.sum("n").over(Window.partitionBy("status"))))
    return c.union(e)


@query
def ner_outcome(spark, d):
    x = D.to_wide(dual_role_ner_counts(spark, d), "lang", "role", "status")
    hit = F.when(F.col("role") == "object", F.col("n_OVS") + F.col("n_OSV")).otherwise(F.col("n_SVO"))
    return x.select("lang", "role", "status", hit.alias("outcome"), (F.col("total") - hit).alias("rest"))


CHUNK_BYTES = 1000


@query
def chunk_assignment(spark, d):
    """Lines of each document in chunks that close at the line which fills them."""
    from ..operators.ordered import greedy_chunks

    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", (F.octet_length("line") + 1).alias("b"))
    chunked = greedy_chunks(lines, "doc_id", F.col("i"), F.col("b"), CHUNK_BYTES)
    return chunked.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_lines"), F.sum("b").cast("long").alias("n_bytes"))


@query
def sessionise_blocks(spark, d):
    from ..sources.conllu import block_ids

    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return block_ids(lines, F.length("line") < 80, ["doc_id"], ["i"]).groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"))


@query
def union_splits(spark, d):
    x = docs(spark, d).select("doc_id", "source")
    split = lambda k: x.where(F.length("source") % 3 == k).select("doc_id", F.lit(k).cast("long").alias("split"))
    u = split(0).unionByName(split(1)).unionByName(split(2))
    return u.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query
def pattern_sorted(spark, d):
    c = counts(spark, d).groupBy("pattern").agg(F.sum("n").alias("n"))
    return c.select(pattern_rank(F.col("pattern")).cast("long").alias("rank"), "pattern", "n")
