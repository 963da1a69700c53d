"""A deterministic pseudo-treebank over ``documents``: lines are sentences, words are tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

BLOCK = 6

#: Bytes of text from which ``rendered`` makes rows at a time; what it holds is some twenty times that.
PIECE = 2 << 20


def upos(form: Column) -> Column:
    n = F.length(form)
    return F.when(n % 3 == 0, "VERB").when(n % 3 == 1, "NOUN").when(n % 2 == 0, "NOUN").otherwise("PROPN")


def sentences(documents: DataFrame, *keep: str, text: bool = False) -> DataFrame:
    """``(doc_id, keep..., line_no, tokens)``, all within the row, with ``text`` also the line itself.

    A block of six places hangs on its first verb; the parity of a word's first letter makes it
    its object or subject.
    """
    lines = documents.select("doc_id", *keep, F.posexplode_outer(F.split("text", "\n")).alias("i", "line")).where("line is not null")
    own = ["line"] if text else []
    words = lines.select("doc_id", *keep, *own, (F.col("i") + 1).alias("line_no"), F.split("line", " ").alias("w"))
    keep = (*keep, *own)

    def first_verb(block: Column) -> Column:
        base = block * BLOCK
        is_verb = lambda x: (x != "") & (F.length(x) % 3 == 0)
        return F.coalesce(*[F.when(is_verb(F.get("w", base + k)), base + k + 1) for k in range(BLOCK)])

    verbs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / BLOCK).cast("int")), first_verb)
    blocks = words.select("doc_id", *keep, "line_no", "w", verbs.alias("verbs"))

    def token(form: Column, i: Column) -> Column:
        verb = F.get("verbs", F.floor(i / BLOCK).cast("int"))
        root = F.coalesce(verb, i + 1) == i + 1
        deprel = F.when(root, "root").when(F.ascii(F.lower(form)) % 2 == 0, "obj").otherwise("nsubj")
        return F.struct((i + 1).alias("id"), form.alias("form"), upos(form).alias("upos"), F.when(root, 0).otherwise(verb).alias("head"), deprel.alias("deprel"))

    tokens = F.filter(F.transform("w", token), lambda t: t["form"] != "")
    # Generated, not projected: what filters on tokens then works on them as they are, and doesn't derive them again.
    return blocks.select("doc_id", *keep, "line_no", F.explode_outer(F.array(tokens)).alias("tokens"))


def tokens(documents: DataFrame, *keep: str) -> DataFrame:
    """One row for each token, in columns."""
    rows = sentences(documents, *keep).select("doc_id", *keep, "line_no", F.inline("tokens"))
    return rows.withColumnRenamed("id", "tok_id")


def rendered(documents: DataFrame, *keep: str, tokens: bool = False) -> DataFrame:
    """``(doc_id, keep..., line_no, line, rows)``: each line that has words, with its tokens as CoNLL-U rows; made in Arrow batches.

    The same trees as those of ``sentences``. With ``tokens`` there is an array of token structs of
    all ten columns in place of ``rows``.
    """
    source = documents.select("doc_id", *keep, "text")
    made = T.ArrayType(_TEN if tokens else T.StringType())
    schema = T.StructType([*source.drop("text").schema, T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("tokens" if tokens else "rows", made)])
    names = schema.names

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                lines = _split(text.slice(low, high - low), "\n")
                words = _split(lines[0], " ")
                yield pa.RecordBatch.from_arrays(_trees(batch.slice(low, high - low), lines, words, tokens), names)

    return source.mapInArrow(run, schema)


_TEN = T.StructType([T.StructField(c, T.IntegerType() if c in ("id", "head") else T.StringType()) for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")])
_UPOS, _FEATS = ("VERB", "NOUN", "PROPN"), ("VerbForm", "A=b", "A=b")
_DEPREL, _MISC = ("root", "obj", "nsubj"), ("NER=O", "A=x|NER=B-x")


def _split(values: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of ``values``, the value each is of, and its place there, from nought; null has no part."""
    lists = pc.split_pattern(values, mark)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return pc.list_flatten(lists), of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _trees(rows: pa.RecordBatch, lines: tuple, words: tuple, tokens: bool) -> list[pa.Array]:
    (line, document, line_at), (form, of, at) = lines, words
    length = pc.utf8_length(form).to_numpy(zero_copy_only=False)
    there = length > 0
    kind = np.where(length % 3 == 0, 0, np.where((length % 3 == 1) | (length % 2 == 0), 1, 2))
    # The first verb of each block of places; a line's first block opens where its places do.
    block = np.cumsum(at % BLOCK == 0) - 1
    verbs = np.flatnonzero(there & (kind == 0))[::-1]
    first = np.zeros(int(block[-1]) + 1 if len(block) else 0, np.int64)
    first[block[verbs]] = at[verbs] + 1  # the last to be put is the first of the block
    head = first[block]
    root = (head == 0) | (head == at + 1)
    head[root] = 0
    letters = pc.utf8_slice_codeunits(form, 0, 1).dictionary_encode()
    known = letters.dictionary.to_pylist() or [""]
    codes = letters.indices.to_numpy(zero_copy_only=False)
    even = np.array([x != "" and ord(x.lower()[0]) % 2 == 0 for x in known])[codes]
    named = np.array([x == x.upper() and x != x.lower() for x in known])[codes] & (kind == 2)
    rel = np.where(root, 0, np.where(even, 1, 2))
    keep = np.flatnonzero(there)
    form, of, at, kind, head, rel, named = form.take(pa.array(keep)), of[keep], at[keep], kind[keep], head[keep], rel[keep], named[keep].astype(np.int64)
    chosen = lambda values, which: pa.array(values, pa.string()).take(pa.array(which))
    ids, heads = pa.array((at + 1).astype(np.int32)), pa.array(head.astype(np.int32))
    if tokens:
        none = pa.array(["_"], pa.string()).take(pa.array(np.zeros(len(at), np.int8)))
        made = pa.StructArray.from_arrays([ids, form, none, chosen(_UPOS, kind), none, chosen(_FEATS, kind), heads, chosen(_DEPREL, rel), none, chosen(_MISC, named)], _TEN.names)
    else:
        middle = chosen([f"_\t{u}\t_\t{f}" for u, f in zip(_UPOS, _FEATS)], kind)
        last = chosen([f"{r}\t_\t{m}" for r in _DEPREL for m in _MISC], rel * len(_MISC) + named)
        made = pc.binary_join_element_wise(ids.cast(pa.string()), form, middle, heads.cast(pa.string()), last, "\t")
    counts = np.bincount(of, minlength=len(line))
    worded = np.flatnonzero(counts)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[worded])]).astype(np.int32)), made)
    owner = pa.array(document[worded])
    return [*[c.take(owner) for c, name in zip(rows.columns, rows.schema.names) if name != "text"], pa.array((line_at[worded] + 1).astype(np.int32)), line.take(pa.array(worded)), lists]
