"""Cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes; where both end a token, a group ends. Groups are few beside
their occurrences, so they are interned: each distinct group is expanded into links between A-ids
and B-ids once, weighted by how often it occurs (or in how many documents), and what its links
are worth is joined back by the group's key. Keys that many documents hold are joined by
broadcast; how many there can be follows from the total, so the broadcast has a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

#: Keys held by more than one in so many (document, group) rows are broadcast: there are fewer of them than this.
HOT = 1 << 16
#: Longer groups are interned by their SHA-256, so no key has more characters.
KEY = 64
#: Units of text that a worker remembers at most, of 0.4 KB each, and the characters of the longest.
REMEMBERED, SHORT = 400_000, 64

#: White space and what some engine may take for it: a unit neither ends nor begins with these.
_DOUBT = r"\s\x00-\x20\x7f-\xa0" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)))
_CUT = re.compile(f"(?<=[^{_DOUBT}]) (?=[^{_DOUBT}])")
#: What may stand in a row with others: it begins and ends as a cut would have it.
_PLAIN = re.compile(f"[^{_DOUBT}](?:.*[^{_DOUBT}])?", re.S)
#: Characters of a row; the space mark of B.
ROW, MARK = 100_000, "\u2581"


#: What a stretch of text with its leading space gives: its groups as written, each of them, and numbers of A and B tokens.
Unit = tuple[str, tuple[str, ...], int, int]


@dataclass
class Aligner:
    """Both tokenizers, whose vocabularies' bytes are known by id.

    A space between two characters that are no white space ends a token of either: A splits there
    before it merges, and no piece of B holds a space mark after another character (checked when
    the model is loaded; else texts are taken whole). Stretches between such places, the units,
    are encoded once and remembered; new ones are put in a row and encoded together.
    """

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    splits: bool
    seen: dict[str, Unit | None] = field(default_factory=dict)
    older: dict[str, Unit | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def units(self, parts: list[str]) -> list[Unit | None] | None:
        """The units of ``parts``, each with a space before it, encoded in a row; None if a tokenizer doesn't give their bytes back."""
        text = "".join([" " + p for p in parts])
        raw, a, b = text.encode(), self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = (np.searchsorted(ends_a, both) + 1).tolist(), (np.searchsorted(ends_b, both) + 1).tolist()
        digits = self.digits.__getitem__
        x, y, groups, i, j = [*map(digits, a)], [*map(digits, b)], [], 0, 0
        for m, n in zip(upto_a, upto_b, strict=True):
            groups.append(intern(f"{x[i]}|{y[j]}" if m - i == 1 == n - j else ",".join(x[i:m]) + "|" + ",".join(y[j:n])))
            i, j = m, n
        last = np.searchsorted(both, np.cumsum([1 + len(p.encode()) for p in parts])) + 1
        out, g, i, j = [], 0, 0, 0
        for h in last.tolist():
            own = tuple(groups[g:h])
            out.append((";".join(own), own, upto_a[h - 1] - i, upto_b[h - 1] - j))
            g, i, j = h, upto_a[h - 1], upto_b[h - 1]
        return out

    def _learn(self, parts: list[str], out: dict[str, Unit | None]) -> None:
        """Puts the units of ``parts`` into ``out``; one by one where a row of them fails."""
        made = self.units(parts)
        if made is None and len(parts) > 1:
            made = [(self.units([p]) or [None])[0] for p in parts]
        out.update(zip(parts, made or [None], strict=True))

    def align(self, texts: list[str]) -> list[tuple[int, int, str, Counter]]:
        """For each text the numbers of A and B tokens, its groups as written and how often each occurs; nothing if its bytes aren't kept."""
        cut = [_CUT.split(t) if self.splits else [t] for t in texts]
        new: dict[str, Unit | None] = {p: None for p in chain.from_iterable(cut) if p not in self.seen}
        row, size, made = [], 0, {}
        for p in new:
            if p in self.older:
                new[p] = self.older[p]
                continue
            if MARK in p:  # B takes it for a space
                continue
            if _PLAIN.fullmatch(p):
                row.append(p)
                size += len(p)
                if size > ROW:
                    self._learn(row, made)
                    row, size = [], 0
            else:
                self._learn([p], made)
        if row:
            self._learn(row, made)
        new.update(made)
        out = []
        for parts in cut:
            units = [self.seen[p] if p in self.seen else new[p] for p in parts]
            if None in units:
                out.append((0, 0, "", Counter()))
                continue
            written, groups = ";".join([u[0] for u in units]), Counter(chain.from_iterable([u[1] for u in units]))
            out.append((sum([u[2] for u in units]), sum([u[3] for u in units]), written, groups))
        if len(self.seen) > REMEMBERED // 2:  # what the newer half doesn't ask for again goes with the older one
            self.older, self.seen = self.seen, {}
        self.seen.update((p, u) for p, u in new.items() if len(p) <= SHORT)
        return out


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: visible ones as themselves, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}


@lru_cache(1)
def aligner(a_json: str, b_model: bytes) -> Aligner:
    """One aligner for each pair of vocabularies and worker process."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(a_json)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    of = _byte_of()
    size_a, size_b = a.get_vocab_size(), b.get_piece_size()
    written = [a.id_to_token(i) for i in range(size_a)]
    bytes_a = [bytes(of[c] for c in t) if t is not None and all(c in of for c in t) else (t or "").encode() for t in written]
    pieces = [b.id_to_piece(i) for i in range(size_b)]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    plain = not any(re.search("[^▁]▁", p) for p in pieces) and b.encode("x  y", out_type=str)[-1].startswith("▁") and b.decode(b.encode(" x  ")) == " x  "
    return Aligner(a, b, bytes_a, bytes_b, plain)


def encoded(docs: DataFrame, a_json: str, b_model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, groups_sha256, groups, long)``: ``groups`` are (key, k) of the distinct ones, ``long`` the texts of interned long ones."""
    shipped = docs.sparkSession.sparkContext.broadcast((a_json, b_model))  # two vocabularies, of fixed size
    key = pa.list_(pa.struct([("key", pa.string()), ("k", pa.int64())]))
    long = pa.list_(pa.struct([("key", pa.string()), ("written", pa.string())]))
    names, kinds = ["n_a", "n_b", "n_groups", "groups_sha256", "groups", "long"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), key, long]

    def text_of(data: pa.BinaryScalar) -> str:
        try:
            return (data.as_py() or b"").decode()
        except UnicodeDecodeError:
            return ""

    def row(n_a: int, n_b: int, written: str, groups: Counter) -> tuple:
        keyed = [(g if len(g) <= KEY else "#" + hashlib.sha256(g.encode()).hexdigest()[1:], g, k) for g, k in groups.items()]
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        return n_a, n_b, sum(groups.values()), sha, [(c, k) for c, _, k in keyed], [(c, g) for c, g, _ in keyed if c[0] == "#"]

    def run(batches):
        x = aligner(*shipped.value)
        for batch in batches:
            for at in range(0, len(batch), 64):  # a few texts' groups at a time
                part = batch.slice(at, 64)
                texts = [text_of(t) for t in part.column(1)]
                found = iter(x.align([t for t in texts if t]))
                columns = zip(*[row(*(next(found) if t else (0, 0, "", Counter()))) for t in texts], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", *names])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("_text"))
    schema = "id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<struct<key:string,k:long>>, long array<struct<key:string,written:string>>"
    return rows.mapInArrow(run, schema)


def links_of(group: str, bytes_a: list[bytes], bytes_b: list[bytes], kind: str) -> Counter:
    """The linked id pairs of one group and how often: tokens whose bytes end together, or (``overlap``) that share a byte."""
    a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
    if kind == "end":
        return Counter([(a[-1], b[-1])])
    out, i, j, end_a, end_b = Counter(), 0, 0, len(bytes_a[a[0]]), len(bytes_b[b[0]])
    while True:
        out[a[i], b[j]] += 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        i, j = i + step_a, j + step_b
        if i == len(a) or j == len(b):
            return out
        end_a += len(bytes_a[a[i]]) if step_a else 0
        end_b += len(bytes_b[b[j]]) if step_b else 0


def group_dictionary(rows: DataFrame) -> DataFrame:
    """``(key, written, freq, docs)`` of every distinct group: how often it occurs, and in how many rows."""
    each = rows.select(F.explode("groups").alias("g")).select("g.*")
    counted = each.groupBy("key").agg(F.sum("k").alias("freq"), F.count("*").alias("docs"))
    long = rows.where(F.size("long") > 0).select(F.explode("long").alias("g")).select("g.*").groupBy("key").agg(F.min("written").alias("written"))
    short = counted.where(~F.col("key").startswith("#")).select("key", F.col("key").alias("written"), "freq", "docs")
    return short.union(counted.where(F.col("key").startswith("#")).join(long, "key").select("key", "written", "freq", "docs"))


def expanded(dictionary: DataFrame, a_json: str, b_model: bytes, kind: str = "end") -> DataFrame:
    """``(key, a, b, m, freq, docs)``: the links of each distinct group, made once; ``m`` is how often the group links the pair."""
    shipped = dictionary.sparkSession.sparkContext.broadcast((a_json, b_model))

    def run(batches):
        x = aligner(*shipped.value)
        for batch in batches:
            at, ids_a, ids_b, times = [], [], [], []
            for i, g in enumerate(batch.column(1)):
                for (a, b), m in links_of(g.as_py(), x.bytes_a, x.bytes_b, kind).items():
                    at.append(i)
                    ids_a.append(a)
                    ids_b.append(b)
                    times.append(m)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(ids_a, pa.int32()), pa.array(ids_b, pa.int32()), pa.array(times, pa.int64()), batch.column(2).take(take), batch.column(3).take(take)], ["key", "a", "b", "m", "freq", "docs"]
            )

    return dictionary.select("key", "written", "freq", "docs").mapInArrow(run, "key string, a int, b int, m long, freq long, docs long")


def pair_counts(links: DataFrame, weight: str = "freq") -> DataFrame:
    """``(a, b, n)`` of each id pair: links in all or, by ``docs``, a count for each row and distinct group of it that holds the pair."""
    return links.groupBy("a", "b").agg(F.sum(F.col("m") * F.col(weight) if weight == "freq" else F.col(weight)).alias("n"))


def with_best(pairs: DataFrame) -> DataFrame:
    """Adds ``best``: whether no pair of the same b has a higher count."""
    most = pairs.groupBy("b").agg(F.max("n").alias("_most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a_json: str, b_model: bytes, id: str = "doc_id", text: str = "text", kind: str = "end", weight: str = "freq") -> DataFrame:
    """One row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` are the links whose pair has its B-id's highest count in the table (ties included),
    ``count_sum`` the counts of all its links' pairs. Under ``kind`` "end" a group has one link.
    Null and empty texts, bytes that are no UTF-8, and texts that a tokenizer doesn't give back
    byte for byte have noughts and an empty digest; rows that repeat, and rows without an id, are
    rows like others; an empty table gives an empty one; other columns are ignored.
    """
    made = stage(encoded(docs, a_json, b_model, id, text).withColumn("_row", F.monotonically_increasing_id()), "align-groups")
    rows = made.df
    dictionary = stage(group_dictionary(rows), "align-dictionary")
    links = stage(expanded(dictionary.df, a_json, b_model, kind), "align-links")
    pairs = stage(pair_counts(links.df, weight), "align-pairs")
    worth = links.df.join(with_best(pairs.df), ["a", "b"])
    values = worth.groupBy("key").agg(F.sum("m").alias("links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("n")).alias("total"), F.max("docs").alias("docs"))
    valued = stage(values, "align-values")
    links.release()
    pairs.release()
    all_rows = dictionary.df.agg(F.sum("docs")).first()[0] or 0
    dictionary.release()
    often = F.col("docs") > all_rows / HOT  # fewer than HOT keys of at most KEY characters
    hot = F.broadcast(valued.df.where(often).drop("docs"))
    each = rows.select("_row", F.explode("groups").alias("g")).select("_row", "g.*")
    sums = [F.sum(F.col("k") * F.col(c)).alias(c) for c in ("links", "best", "total")]
    known = each.join(hot, "key").groupBy("_row").agg(*sums)
    rare = each.join(F.broadcast(valued.df.where(often).select("key")), "key", "left_anti").join(valued.df.where(~often).drop("docs"), "key").groupBy("_row").agg(*sums)
    facts = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
    nought, none = [F.lit(0).cast("long").alias(c) for c in ("links", "best", "total")], [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in facts]
    parts = rows.select("_row", *facts, *nought).union(known.select("_row", *none, "links", "best", "total")).union(rare.select("_row", *none, "links", "best", "total"))
    whole = parts.groupBy("_row").agg(*[F.max(c).alias(c) for c in facts], *[F.sum(c).alias(c) for c in ("links", "best", "total")])
    return whole.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", F.col("links").alias("n_links"), F.col("best").alias("n_best"), F.col("total").alias("count_sum"), "groups_sha256")


def load_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
