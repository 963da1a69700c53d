"""Tree patterns: a verb with a subject and an object child, classified by surface order.

Sentences are rows with an array of token structs, so a match needs no join and no second scan:
candidates are sifted once a row and dealt by their head into about as many lists as each list
is long, so that a sentence of n tokens takes n to the power of 1.5 at worst. ``match_by_join``
finds the same by an equi-join on (sentence, head).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import generated
from ..schema import PATTERNS


@dataclass(frozen=True)
class TreeQuery:
    """Predicates of the head and its two children; an empty set of tags admits any."""

    head: frozenset[str] = frozenset({"VERB"})
    subject: frozenset[str] = frozenset({"NOUN"})
    object: frozenset[str] = frozenset({"NOUN"})
    subject_rel: str = "nsubj"
    object_rel: str = "obj"
    collapse_subtypes: bool = False

    @classmethod
    def parse(cls, text: str, collapse_subtypes: bool = False) -> TreeQuery:
        """``upos=VERB >nsubj upos=NOUN >obj _``; alternatives of a tag are joined by ``|``."""
        head, *children = re.split(r"\s+>", text.strip())
        found = [c.split(None, 1) for c in children]
        if len(found) != 2 or any(len(c) != 2 for c in found):
            raise ValueError(f"two children with a relation and a node are needed: {text!r}")
        (first, a), (second, b) = found
        return cls(_tags(head), _tags(a), _tags(b), first, second, collapse_subtypes)

    def relation(self, deprel: Column) -> Column:
        return F.substring_index(deprel, ":", 1) if self.collapse_subtypes else deprel


def _tags(node: str) -> frozenset[str]:
    node = node.strip()
    if node == "_":
        return frozenset()
    attribute, _, value = node.partition("=")
    if attribute != "upos" or not value:
        raise ValueError(f"only upos=TAG and _ are known, not {node!r}")
    return frozenset(value.split("|"))


NOUNS = TreeQuery()
NOUNS_AND_NAMES = TreeQuery(subject=frozenset({"NOUN", "PROPN"}), object=frozenset({"NOUN", "PROPN"}))
BROAD = TreeQuery(subject=frozenset(), object=frozenset())


def order_of(s: Column, v: Column, o: Column) -> Column:
    """The order of three token ids as one of PATTERNS."""
    places = {"S": s, "V": v, "O": o}
    out = None
    for p in PATTERNS:
        a, b, c = (places[x] for x in p)
        hit = (a < b) & (b < c)
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out


def _is(token: Column, tags: frozenset[str]) -> Column:
    return token["upos"].isin(*sorted(tags)) if tags else F.lit(True)


def with_matches(sentences: DataFrame, query: TreeQuery = NOUNS, tokens: str = "tokens") -> DataFrame:
    """The other columns of ``sentences`` and ``matches``: an array of ``(s, v, o)`` token structs, empty if there are none.

    Null sentences have no matches; a token whose head is in no list is no one's child; of verbs
    that share an id each has the children.
    """
    keys = [c for c in sentences.columns if c != tokens]
    side = lambda rel, tags: F.filter(tokens, lambda t: (query.relation(t["deprel"]) == rel) & _is(t, tags))
    verbs = F.filter(tokens, lambda t: _is(t, query.head))
    sifted = generated(sentences, keys, _verbs=verbs, _subjects=side(query.subject_rel, query.subject), _objects=side(query.object_rel, query.object))
    whole = (F.size("_verbs") > 0) & (F.size("_subjects") > 0) & (F.size("_objects") > 0)
    none = F.slice("_subjects", 1, 0)
    lists = F.ceil(F.sqrt(F.greatest(F.size("_verbs"), F.size("_objects")))).cast("int")
    deal = lambda of, key: F.transform(F.sequence(F.lit(0), lists - 1), lambda k: F.filter(of, lambda t: F.pmod(t[key], lists) == k))
    dealt = generated(
        sifted, keys, _subjects=F.when(whole, F.col("_subjects")).otherwise(none), _lists=lists, _by_id=F.when(whole, deal("_verbs", "id")), _by_head=F.when(whole, deal("_objects", "head"))
    )

    def of(s: Column) -> Column:
        at = F.pmod(s["head"], F.col("_lists"))
        mine = F.filter(F.get("_by_head", at), lambda o: o["head"] == s["head"])
        heads = F.filter(F.get("_by_id", at), lambda v: v["id"] == s["head"])
        return F.flatten(F.transform(heads, lambda v: F.transform(mine, lambda o: F.struct(s.alias("s"), v.alias("v"), o.alias("o")))))

    return dealt.select(*keys, F.coalesce(F.flatten(F.transform("_subjects", of)), F.array()).alias("matches"))


def match(sentences: DataFrame, query: TreeQuery = NOUNS, tokens: str = "tokens") -> DataFrame:
    """One row for each instance: the other columns of ``sentences``, then s, v, o (token structs) and pattern."""
    keys = [c for c in sentences.columns if c != tokens]
    found = with_matches(sentences, query, tokens).select(*keys, F.explode_outer("matches").alias("m")).where("m is not null")
    return found.select(*keys, "m.s", "m.v", "m.o", order_of(F.col("m.s.id"), F.col("m.v.id"), F.col("m.o.id")).alias("pattern"))


def count_in_row(sentences: DataFrame, query: TreeQuery = NOUNS, tokens: str = "tokens") -> DataFrame:
    """The other columns of ``sentences`` and its six counts ``n_SVO ... n_OVS``, without leaving the row."""
    keys = [c for c in sentences.columns if c != tokens]
    orders = F.transform("matches", lambda m: order_of(m["s"]["id"], m["v"]["id"], m["o"]["id"]))
    found = generated(with_matches(sentences, query, tokens), keys, _orders=orders)
    count = lambda p: F.size(F.filter("_orders", lambda x: x == p)).cast("long")
    return found.select(*keys, *[count(p).alias(f"n_{p}") for p in PATTERNS])


def match_by_join(sentences: DataFrame, query: TreeQuery = NOUNS, tokens: str = "tokens") -> DataFrame:
    """The same instances by an equi-join on sentence and head; ``sentences`` needs keys that tell its rows apart."""
    keys = [c for c in sentences.columns if c != tokens]
    long = sentences.select(*keys, F.explode_outer(tokens).alias("t")).where("t is not null")
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    at = [f"_{k}" for k in keys]

    def side(name: str, rel: str, tags: frozenset[str]) -> DataFrame:
        rows = long.where((query.relation(F.col("t.deprel")) == rel) & _is(F.col("t"), tags))
        return rows.select(*same, F.col("t.head").alias("_head"), F.col("t").alias(name))

    verbs = long.where(_is(F.col("t"), query.head)).select(*keys, *same, F.col("t.id").alias("_head"), F.col("t").alias("v"))
    found = verbs.join(side("s", query.subject_rel, query.subject), [*at, "_head"]).join(side("o", query.object_rel, query.object), [*at, "_head"])
    return found.select(*keys, "s", "v", "o", order_of(F.col("s.id"), F.col("v.id"), F.col("o.id")).alias("pattern"))


def order_counts(instances: DataFrame, *groups: str) -> DataFrame:
    """``(groups..., pattern, n)``."""
    return instances.groupBy(*groups, "pattern").agg(F.count("*").alias("n"))


def dual_roles(instances: DataFrame, status: Callable[[Column], Column], *groups: str) -> DataFrame:
    """``(groups..., role, status, pattern, n)``: each instance counts once by its subject and once by its object."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), status(F.col(c)).alias("status")) for r, c in (("subject", "s"), ("object", "o"))])
    long = instances.select(*groups, "pattern", F.inline(roles))
    return long.groupBy(*groups, "role", "status", "pattern").agg(F.count("*").alias("n"))


def misc_items(misc: Column) -> Column:
    return F.when(misc == "_", F.array().cast("array<string>")).otherwise(F.split(misc, r"\|"))


def ner_status(misc: Column) -> Column:
    """``entity`` if the first NER item (key in any case) starts with B- or I-, else ``common``."""
    first = F.get(F.filter(misc_items(misc), lambda x: F.upper(x).startswith("NER=")), F.lit(0))
    tag = F.upper(F.substring(first, 5, 1_000_000))
    return F.when(tag.startswith("B-") | tag.startswith("I-"), "entity").otherwise("common")


def misc_upsert(misc: Column, tag: Column) -> Column:
    """MISC with its NER items replaced by one of the given tag, put last."""
    rest = F.filter(misc_items(misc), lambda x: ~F.upper(x).startswith("NER=") & (x != ""))
    return F.array_join(F.concat(rest, F.array(F.concat(F.lit("NER="), tag))), "|")


#: What marks the relation of a word in a linearised tree, and the letter it stands for; anything else is a word.
MARKS = {"<nsubj": "S", ">nsubj": "S", "<obj": "O", ">obj": "O"}


def classify_linear(tree: Column) -> Column:
    """The order of a linearised tree such as ``A <nsubj B >obj C``; '' unless it has one S, V and O.

    ``>rel`` names the next word, ``<rel`` the word before it (none: ''); an unnamed word is the verb.
    """
    parts = F.filter(F.split(F.trim(tree), r"\s+"), lambda x: x != "")
    letter = lambda x: F.coalesce(*[F.when(x == m, c) for m, c in MARKS.items()])
    state = lambda said, waiting, ok: F.struct(said.alias("said"), waiting.alias("waiting"), ok.alias("ok"))
    nothing = F.lit(None).cast("string")

    def step(s: Column, x: Column) -> Column:
        word = state(F.concat(s["said"], F.coalesce(s["waiting"], F.lit("V"))), nothing, s["ok"])
        ahead = state(s["said"], letter(x), s["ok"])
        behind = state(F.concat(F.substring(s["said"], F.lit(1), F.length(s["said"]) - 1), letter(x)), s["waiting"], s["ok"] & (s["said"] != ""))
        return F.when(letter(x).isNull(), word).when(x.startswith(">"), ahead).otherwise(behind)

    end = F.aggregate(parts, state(F.lit(""), nothing, F.lit(True)), step)
    return F.when(end["ok"] & end["said"].isin(*PATTERNS), end["said"]).otherwise("")
