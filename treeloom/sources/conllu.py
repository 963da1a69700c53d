"""CoNLL-U: one parameterised reader, block-level repairs and a writer.

Files are read by line, in splits, whatever their size; lines are put into blocks by counts of
block starts within each split and a small table of the splits. Files that are known to have LF
ends and empty separators can be read by block (``plain``), which Spark's own text source does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rows import generated
from ..operators.ordered import greedy_chunks
from ..schema import TOKEN
from .scratch import matching, own_folder, unsorted_writes

#: Substrings of a ``# term =`` line that name a genre, first match wins (fixed values of the corpus format).
GENRES = (
    ("zvrst / umetnostna", "leposlovno"),
    ("zvrst / neumetnostna / strokovna", "strokovno"),
    ("zvrst / neumetnostna / nestrokovna", "publicisticno_splosno"),
)
_ID = r"^[0-9]+$"


BLANK = " \t\x0b\x0c\r"


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """``(file, start, id, value)``: lines with LF or CRLF ends, told apart and ordered by their split's offset and their place in it."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")


def genre_event(line: Column) -> Column:
    """What a line does to the genre in force, as ``struct(genre)``: a new document ends it, a mapped term sets it; null for other lines."""
    genre = genre_of(line)
    return F.when(line.startswith("# newdoc"), F.struct(F.lit(None).cast("string").alias("genre"))).when(line.startswith("# term =") & genre.isNotNull(), F.struct(genre.alias("genre")))


def _carried(splits: DataFrame, value: Column, name: str, back: bool = False) -> DataFrame:
    """Adds the last ``value`` that is not null of the splits before each (or, ``back``, the first of those after)."""
    order = Window.partitionBy("file").orderBy(F.desc("start") if back else F.col("start")).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(name, F.last(value, ignorenulls=True).over(order))


def blocks(spark: SparkSession, path: str | list[str], plain: bool = False, recursive: bool = False, attach: bool = False, genres: bool = False, keep_bom: bool = False) -> DataFrame:
    """``(file, ord, lines)``: the lines of each block; ``ord`` orders the blocks of a file.

    Lines of white space part blocks. A line opens a block if the line before it parts, also
    across splits; what a task orders is one split. gz files are decompressed by extension and
    are one split each. ``plain`` promises LF ends and empty separators.

    With ``genres`` there is a column ``genre``: the one in force at a block's last line, which
    may have been set in an earlier split. With ``attach`` blocks of comments alone are put before
    the next other block of their file, whichever split it is in, and dropped if there is none.
    Blocks that lie within a split are made where it is read and not shuffled; only the lines at
    both ends of the splits are, which are staged when this is called. The state is folded within
    a split, a table of a row for each split is scanned, and what came before (or comes after) a
    split is applied to its blocks. Files that are all gz have no such ends and are read once.
    """
    if plain and not (attach or genres):
        raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n\n").text(path)
        raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("ord"), "value")
        cut = raw.select("file", F.format_string("%016d-%020d", "at", "ord").alias("ord"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
        return cut.where(F.size("lines") > 0)
    raw = read_lines(spark, path, recursive).withColumn("blank", F.btrim("value", F.lit(BLANK)) == "")
    event = F.lit(None).cast("string")
    if genres:
        found = genre_event(F.col("value") if keep_bom else F.regexp_replace("value", "^\ufeff", ""))
        event = F.when(F.col("value").contains("# "), F.when(found.isNotNull(), F.coalesce(found["genre"], F.lit(""))))
    raw = raw.select("file", "start", "value", "blank", event.alias("event"))
    name = lambda start, line: F.format_string("%016d", F.col(start) + F.col(line)).alias("ord")  # noqa: E731  # a line is a byte at least, so a split's numbers end before the next one's start
    if all(x.endswith(".gz") for x in raw.inputFiles()):
        read = raw.mapInArrow(_folding(attach, False, True), "file string, start long, id long, lines array<string>, event string")
        return read.select("file", name("start", "id"), "lines", *([F.nullif("event", F.lit("")).alias("genre")] if genres else []))
    whole = raw.mapInArrow(_folding(attach, False), "file string, start long, id long, lines array<string>, event string")
    lines = _edges(raw.mapInArrow(_folding(attach, True), "file string, start long, id long, value string, blank boolean, event string"))
    lines = lines.withColumn("event", F.when(F.col("event").isNotNull(), F.struct(F.nullif("event", F.lit("")).alias("genre"))))
    own = Window.partitionBy("file", "start").orderBy("id")
    opens = ~F.col("blank") & F.coalesce(F.lag("blank").over(own), F.lit(False))
    lines = lines.withColumn("opened", F.sum(opens.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    facts = [F.max("opened").alias("inner"), F.min_by("blank", "id").alias("blank_first"), F.max_by("blank", "id").alias("blank_last")]
    if genres:
        lines = lines.withColumn("state", F.last("event", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        facts.append(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("id"))).alias("event_last"))
    if attach:
        row = F.when(~F.col("blank") & ~F.col("value").startswith("#"), F.col("opened"))
        back = Window.partitionBy("file", "start").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
        lines = lines.withColumn("row", row).withColumn("row_before", F.last("row", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row_after", F.last("row", ignorenulls=True).over(back))
        facts += [F.min("row").alias("row_first"), F.max("row").alias("row_last")]
    order = Window.partitionBy("file").orderBy("start")  # of a file's splits
    splits = lines.groupBy("file", "start").agg(*facts)
    at_edge = ~F.col("blank_first") & F.coalesce(F.lag("blank_last").over(order), F.lit(True))
    splits = splits.withColumn("edge", at_edge.cast("long"))
    before = F.coalesce(F.sum(F.col("inner") + F.col("edge")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits, more = splits.withColumn("base", before + F.col("edge")), []
    if genres:
        splits = _carried(splits, F.col("event_last"), "event_before")
        more.append("event_before")
    if attach:
        splits = _carried(splits, F.col("base") + F.col("row_last"), "ord_before")
        splits = _carried(splits, F.col("base") + F.col("row_first"), "ord_after", back=True)
        more += ["ord_before", "ord_after"]
    splits = splits.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("base").alias("_base"), *more)
    placed = lines.where("not blank").join(splits, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    number = F.col("_base") + F.col("opened")
    if attach:
        last, following = F.coalesce(F.col("_base") + F.col("row_before"), F.col("ord_before")), F.coalesce(F.col("_base") + F.col("row_after"), F.col("ord_after"))
        placed = placed.withColumn("_number", F.when(F.coalesce(last == number, F.lit(False)), number).otherwise(following)).where("_number is not null")
        number = F.col("_number")
    at = F.struct("start", "id")
    states = [F.max_by(F.coalesce("state", "event_before"), at).getField("genre").alias("genre")] if genres else []
    held = placed.withColumn("_number", number).groupBy("file", "_number").agg(F.sort_array(F.collect_list(F.struct("start", "id", "value"))).alias("held"), F.min(at).alias("at"), *states)
    edges = held.select("file", name("at.start", "at.id"), F.col("held.value").alias("lines"), *(["genre"] if genres else []))
    if genres:
        before = splits.select("_file", "_start", F.col("event_before.genre").alias("_genre"))
        whole = whole.join(F.broadcast(before), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left")  # a row for each split
        whole = whole.withColumn("genre", F.when(F.col("event").isNull(), F.col("_genre")).otherwise(F.nullif("event", F.lit(""))))
    return whole.select("file", name("start", "id"), "lines", *(["genre"] if genres else [])).union(edges)


def _edges(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, in files that no setting of split sizes cuts: it is far smaller than what its splits come from."""
    path = own_folder(df.sparkSession, "conllu-edges")
    df.write.json(path, compression="gzip")
    return df.sparkSession.read.schema(df.schema).json(path)


class _Fold:
    """The lines of a split put into blocks as they come.

    ``step`` gives the blocks that are whole whatever the other splits hold. The rest, those at
    both ends of the split (with ``attach`` also the first that has rows, and comments that wait
    at its end), are its edges: their lines, blank ones too, and one blank line in place of all
    between, which has the last event before it. The one split of a file that can't be cut
    (``closed``) has no edges: what is left at its end comes with ``rest``.
    """

    def __init__(self, file: str, start: int, attach: bool, closed: bool = False) -> None:
        self.file, self.start, self.attach = file, start, attach
        self.at, self.begun, self.state, self.edges = 0, closed, None, []
        self.values, self.blank, self.events = pa.array([], pa.string()), np.zeros(0, bool), pa.array([], pa.string())

    def edge(self, low: int, high: int, event: str | None = None) -> None:
        n = high - low
        blank = self.blank[low:high]
        events = self.events[low:high]
        if event is not None and n and blank[0]:
            events = pa.concat_arrays([pa.array([event], pa.string()), events[1:]])
        self.edges.append((np.arange(self.at + low, self.at + high), self.values[low:high], blank, events))

    def step(self, values: pa.Array, blank: np.ndarray, events: pa.Array):
        """``(ids, lines, events)`` of the blocks that the next lines complete."""
        self.values, self.blank, self.events = pa.concat_arrays([self.values, values]), np.concatenate([self.blank, blank]), pa.concat_arrays([self.events, events])
        n, filled = len(self.blank), ~self.blank
        starts = np.flatnonzero(filled & np.concatenate([[True], self.blank[:-1]]))
        ends = np.flatnonzero(filled & np.concatenate([self.blank[1:], [True]]))
        whole = int((ends < n - 1).sum())
        if self.attach:
            rows = np.concatenate([[0], np.cumsum(filled & ~pc.starts_with(self.values, "#").to_numpy(zero_copy_only=False))])
            closing = np.flatnonzero(rows[ends[:whole] + 1] > rows[starts[:whole]])
            low, high = starts[np.concatenate([[0], closing[:-1] + 1])] if len(closing) else closing, ends[closing]
            cut = int(high[-1]) + 1 if len(high) else 0
        else:
            low, high, cut = starts[:whole], ends[:whole], int(starts[whole]) if whole < len(starts) else n
        if not self.begun and n and (len(high) or (not self.attach and self.blank[0])):
            self.begun = True
            if self.attach or not self.blank[0]:
                self.edge(0, int(high[0]) + 1)
                low, high = low[1:], high[1:]
            else:
                self.edge(0, 1)
        seen = np.maximum.accumulate(np.where(self.events.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)) if n else np.zeros(0, int)
        found = [self.state if seen[e] < 0 else self.events[int(seen[e])].as_py() for e in high] if self.events.null_count < n or self.state is not None else [None] * len(high)
        held = np.zeros(n + 1, int)
        np.add.at(held, low, 1)
        np.add.at(held, high + 1, -1)
        mine = (np.cumsum(held)[:n] > 0) & filled
        counts = np.concatenate([[0], np.cumsum(mine)])
        offsets = np.concatenate([[0], counts[high + 1]]).astype(np.int32)
        out = (self.at + low, pa.ListArray.from_arrays(pa.array(offsets), self.values.filter(pa.array(mine))), pa.array(found, pa.string()))
        if cut and seen[cut - 1] >= 0:
            self.state = self.events[int(seen[cut - 1])].as_py()
        self.values, self.blank, self.events, self.at = self.values[cut:], self.blank[cut:], self.events[cut:], self.at + cut
        return out

    def rest(self):
        """What ``step`` gives for a line that parts, put at the end of the file; with ``attach``, comments that still wait are dropped."""
        return self.step(pa.array([""]), np.array([True]), pa.array([None], pa.string()))

    def end(self):
        """``(ids, values, blank, events)`` of the edges, once all lines have come."""
        if self.attach:
            self.edge(0, len(self.blank), self.state)
        else:
            if self.at > 1:
                self.edges.append((np.array([self.at - 1]), pa.array([""]), np.array([True]), pa.array([self.state], pa.string())))
            self.edge(0, len(self.blank))
        return (np.concatenate([e[0] for e in self.edges]), pa.concat_arrays([e[1] for e in self.edges]), np.concatenate([e[2] for e in self.edges]), pa.concat_arrays([e[3] for e in self.edges]))


def _folding(attach: bool, edges: bool, closed: bool = False):
    """Lines as they are read, to the whole blocks of each split or to the lines of its edges; ``closed``: each split is a file."""

    def rows(fold: _Fold, names: list[str], ids: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([fold.file], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, fold.start, np.int64)), pa.array(ids.astype(np.int64)), *columns], ["file", "start", "id", *names])

    def ended(fold: _Fold | None):
        if fold is not None and edges:
            ids, values, blank, events = fold.end()
            yield rows(fold, ["value", "blank", "event"], ids, values, pa.array(blank), events)
        elif fold is not None and closed:
            ids, lines, events = fold.rest()
            if len(ids):
                yield rows(fold, ["lines", "event"], ids, lines, events)

    def run(batches):
        fold = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, start, value, blank, event = batch.columns
            code, begin, blank = file.dictionary_encode().indices.to_numpy(zero_copy_only=False), start.to_numpy(), blank.to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (begin[1:] != begin[:-1])) + 1), n]
            for low, high in zip(turns, turns[1:]):
                name, low, high = file[int(low)].as_py(), int(low), int(high)
                if fold is None or (fold.file, fold.start) != (name, int(begin[low])):
                    yield from ended(fold)
                    fold = _Fold(name, int(begin[low]), attach, closed)
                ids, lines, events = fold.step(value[low:high], blank[low:high], event[low:high])
                if len(ids) and not edges:
                    yield rows(fold, ["lines", "event"], ids, lines, events)
        yield from ended(fold)

    return run


def strip_bom(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(x.startswith("\ufeff"), F.substring(x, 2, 1_000_000_000)).otherwise(x))


def fields(line: Column) -> Column:
    return F.split(line, "\t")


def token(x: Column, names: Sequence[str] = TOKEN.names) -> Column:
    """A token struct of a row's fields, with those of ``names``; a HEAD that is no number becomes 0."""
    at = lambda i: F.get(x, F.lit(i))
    made = {name: at(i) for i, name in enumerate(TOKEN.names)} | {"id": at(0).cast("int"), "head": F.when(at(6).rlike(_ID), at(6).cast("int")).otherwise(0)}
    return F.struct(*[made[name].alias(name) for name in names])


def read_conllu(spark: SparkSession, path: str | list[str], min_cols: int = 8, exact_cols: int | None = None, keep_bom: bool = False, plain: bool = False, recursive: bool = False, strict: bool = False, genres: bool = False, attach: bool = False, names: Sequence[str] = TOKEN.names) -> DataFrame:
    """One row a sentence: file, ord, comments, tokens (last row of a repeated id wins), text, is_fallback; with ``genres`` also genre.

    Rows count as tokens if their ID is a whole number and they have ``min_cols`` columns (or
    exactly ``exact_cols``); ranges, empty nodes and other rows are left out. ``text`` is the
    ``# text =`` comment as it stands, or else the forms joined by spaces. With ``strict`` a
    sentence of two different texts is an error. ``genres`` and ``attach`` are as in ``blocks``.
    Tokens have the fields of ``names``, and no other is made.
    """
    b, more = blocks(spark, path, plain, recursive, attach, genres, keep_bom), ["genre"] if genres else []
    lines = F.col("lines") if keep_bom else strip_bom(F.col("lines"))
    b = b.withColumn("lines", lines)
    wide_enough = (lambda n: n == exact_cols) if exact_cols else (lambda n: n >= min_cols)
    # A line is cut into fields once; what makes ``text`` is left to the last projection, which is made only if it is asked for.
    numbered = F.filter(F.transform(F.filter("lines", lambda x: ~x.startswith("#")), fields), lambda x: F.get(x, F.lit(0)).rlike(_ID))
    b = generated(b, ["file", "ord", *more], comments=F.filter("lines", lambda x: x.startswith("#")), numbered=numbered).where(F.size("numbered") > 0)
    rows = F.transform(F.filter("numbered", lambda x: wide_enough(F.size(x))), lambda x: F.struct(F.get(x, F.lit(0)).cast("int").alias("id"), token(x, names).alias("t")))
    placed = F.sort_array(F.transform(rows, lambda r, i: F.struct(r["id"].alias("id"), i.alias("i"), r["t"].alias("t"))))
    b = generated(b, ["file", "ord", "comments", "numbered", *more], placed=placed)
    last = F.filter("placed", lambda x, i: F.coalesce(F.get("placed", i + 1)["id"] != x["id"], F.lit(True)))
    texts = F.array_distinct(F.filter("comments", lambda x: x.startswith("# text = ")))
    forms = F.array_join(F.transform("numbered", lambda x: F.get(x, F.lit(1))), " ")
    said = F.get(texts, F.lit(0))
    if strict:
        said = F.when(F.size(texts) > 1, F.raise_error(F.concat(F.lit("two texts in one sentence: "), F.array_join(texts, " / ")))).otherwise(said)
    return b.select("file", "ord", "comments", F.transform(last, lambda x: x["t"]).alias("tokens"), F.coalesce(F.substring(said, 10, 1_000_000_000), forms).alias("text"), said.isNull().alias("is_fallback"), *more)


def violations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, ord, line, rule)`` of every line that breaks the format: width, HEAD, conflicting texts."""
    mark = "\ufeff"
    bare = lambda x: F.when(x.startswith(mark), F.substring(x, 2, 1_000_000_000)).otherwise(x)
    texts = F.array_distinct(F.transform(F.filter("lines", lambda x: x.startswith("# text = ") | x.startswith(f"{mark}# text = ")), bare))
    # A second text follows a block's lines, so that they are read once.
    each = blocks(spark, path).select("file", "ord", F.size("lines").alias("n"), F.posexplode(F.concat("lines", F.slice(texts, 2, 1))).alias("at", "line"))
    each = each.select("file", "ord", bare(F.col("line")).alias("line"), (F.col("at") >= F.col("n")).alias("second"))
    x = fields(F.col("line"))
    row = F.when(F.size(x) != 10, "columns").when(F.get(x, F.lit(0)).rlike(_ID) & ~F.get(x, F.lit(6)).rlike(_ID), "head")
    return each.withColumn("rule", F.when(F.col("second"), "text").when(~F.col("line").startswith("#"), row)).where("rule is not null").select("file", "ord", "line", "rule")


def profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks (with those of comments alone), tokens and tokens with an NER item, by file."""
    b = blocks(spark, path)
    numbered = F.filter("lines", lambda x: F.get(fields(x), F.lit(0)).rlike(_ID))
    tagged = F.filter(numbered, lambda x: F.exists(F.split(F.coalesce(F.get(fields(x), F.lit(9)), F.lit("")), r"\|"), lambda m: F.upper(m).startswith("NER=")))
    return b.groupBy("file").agg(F.count("*").alias("blocks"), F.sum(F.size(numbered)).alias("tokens"), F.sum(F.size(tagged)).alias("ner_tokens"))


def genre_of(term: Column) -> Column:
    out = F.lit(None).cast("string")
    for mark, genre in reversed(GENRES):
        out = F.when(term.contains(mark), genre).otherwise(out)
    return out


def repair_roots(tokens: str) -> Column:
    """Tokens (with a string head) whose root lacks a head, given head 0."""
    return F.transform(tokens, lambda t: t.withField("head", F.when((t["head"] == "_") & (t["deprel"] == "root"), "0").otherwise(t["head"])))


def unattached(tokens: str) -> Column:
    """Whether the (string) head of any token is no number after repair: such sentences are dropped."""
    return F.exists(tokens, lambda t: ~F.coalesce(t["head"].rlike(_ID), F.lit(False)))


def headless(lines: str) -> Column:
    """Whether any numbered row of a block has a head that is no number, a root's ``_`` apart: such sentences are dropped."""

    def bad(x):
        f = fields(x)
        at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
        return ~x.startswith("#") & at(0).rlike(_ID) & ~at(6).rlike(_ID) & ~((at(6) == "_") & (at(7) == "root"))

    return F.exists(lines, bad)


def cleaned(blocks_: DataFrame) -> DataFrame:
    """Blocks ready for a tree engine, with ``dropped``: rows of another width or without a head drop a block (its lines stay as they are).

    In the others, FEATS without ``=`` and DEPS without ``:`` become ``_`` and a root without a head gets 0.
    """

    keys = [c for c in blocks_.columns if c != "lines"]
    cut = generated(blocks_, [*keys, "lines"], _rows=F.transform("lines", lambda x: F.when(~x.startswith("#"), fields(x))))  # a line is cut into fields once
    at = lambda f, i: F.get(f, F.lit(i))

    def bad(f):
        cell = lambda i: F.coalesce(at(f, i), F.lit(""))
        headless = cell(0).rlike(_ID) & ~cell(6).rlike(_ID) & ~((cell(6) == "_") & (cell(7) == "root"))
        return f.isNotNull() & ((F.size(f) != 10) | headless)

    def fixed(f, i):
        feats = F.when(at(f, 5).contains("="), at(f, 5)).otherwise("_")
        head = F.when((at(f, 6) == "_") & (at(f, 7) == "root") & at(f, 0).rlike(_ID), "0").otherwise(at(f, 6))
        deps = F.when(at(f, 8).contains(":"), at(f, 8)).otherwise("_")
        return F.when(f.isNull(), F.get("lines", i)).otherwise(F.concat_ws("\t", *[at(f, k) for k in range(5)], feats, head, at(f, 7), deps, at(f, 9)))

    judged = generated(cut, [*keys, "lines", "_rows"], dropped=F.exists("_rows", bad))
    return judged.select(*keys, F.when(F.col("dropped"), F.col("lines")).otherwise(F.transform("_rows", fixed)).alias("lines"), "dropped").select(*blocks_.columns, "dropped")


def wrong_width(lines: str, width: int = 10) -> Column:
    """Whether any row of a block that is no comment has another number of columns: such sentences are dropped."""
    return F.exists(lines, lambda x: ~x.startswith("#") & (F.size(fields(x)) != width))


def structural(line: Column) -> Column:
    """A row's first nine columns: all but MISC."""
    return F.slice(fields(line), 1, 9)


def genre_counts(sentences: DataFrame, genre: str, has_syntax: Column | None = None) -> DataFrame:
    """``(genre, n)`` of the sentences kept, and under ``(no genre)`` and ``(no syntax)`` those skipped for it."""
    syntax = F.lit(True) if has_syntax is None else has_syntax
    name = F.when(F.col(genre).isNull(), "(no genre)").when(~syntax, "(no syntax)").otherwise(F.col(genre))
    return sentences.groupBy(name.alias("genre")).agg(F.count("*").alias("n"))


def labelled(sentences: DataFrame, genre: str, label: str | None = None) -> DataFrame:
    """The group each sentence counts under: ``label`` for all if given, else its genre."""
    return sentences.withColumn(genre, F.lit(label) if label is not None else F.col(genre))


def sanitise(tokens: str) -> Column:
    """FEATS without ``=`` and DEPS without ``:`` become ``_``."""
    fix = lambda x, mark: F.when(x.contains(mark), x).otherwise("_")
    return F.transform(tokens, lambda t: t.withField("feats", fix(t["feats"], "=")).withField("deps", fix(t["deps"], ":")))


def carry_forward(rows: DataFrame, reset: Column, mark: str, name: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``name``: the last non-null ``mark`` since the last reset (a reset row starts anew)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumn("_part", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn(name, F.last(mark, ignorenulls=True).over(own)).drop("_part")


def attach_pending(rows: DataFrame, pending: Column, text: str, by: list[str], order: list[str]) -> DataFrame:
    """Pending rows (comment-only blocks) put before the next other row's text; those after the last are dropped."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    part = rows.withColumn("_p", pending).withColumn("_part", F.coalesce(F.sum(F.when(~F.col("_p"), 1).otherwise(0)).over(before), F.lit(0)))
    at = F.struct(*order)
    grouped = part.groupBy(*by, "_part").agg(
        F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(text).alias("x")))).getField("x").alias("_all"), F.count_if(F.col("_p")).alias("n_pending"), F.max(F.when(~F.col("_p"), at)).alias("_at")
    )
    return grouped.where("_at is not null").select(*by, *[F.col(f"_at.{o}").alias(o) for o in order], F.array_join("_all", "\n").alias(text), "n_pending")


def block_ids(lines: DataFrame, separator: Column, by: list[str], order: list[str]) -> DataFrame:
    """Lines that are no separators, with the number of their block: separators before them, runs counted once."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = lines.withColumn("_sep", separator)
    opens = ~F.col("_sep") & F.coalesce(F.lag("_sep").over(w), F.lit(True))
    running = F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("block", running.cast("long")).where(~F.col("_sep")).drop("_sep")


def rendered() -> Column:
    """A sentence as a block of lines."""
    cells = lambda t: F.concat_ws("\t", *[F.coalesce(t[c].cast("string"), F.lit("_")) for c in ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")])
    return F.array_join(F.concat("comments", F.transform("tokens", cells)), "\n")


def render(sentences: DataFrame) -> DataFrame:
    """``value``: each sentence as a block, for ``write.text`` with ``lineSep`` of two line ends."""
    return sentences.select(rendered().alias("value"))


def write_conllu(sentences: DataFrame, path: str, by: str | None = None, **options: str) -> None:
    """Writes blocks, one directory for each value of ``by`` if given; rows without one are left out. ``options`` are the text sink's."""
    options = {"lineSep": "\n\n"} | options
    if by is None:
        render(sentences).write.options(**options).text(path)
    else:
        with unsorted_writes(sentences.sparkSession):  # a sort would spill all that is written, unpacked
            sentences.where(F.col(by).isNotNull()).select(by, rendered().alias("value")).write.partitionBy(by).options(**options).text(path)


def annotate(sentences: DataFrame, tagger, batch: int = 2000) -> DataFrame:
    """Gives tokens NER items from ``tagger(list of form lists) -> list of tag lists`` of the same lengths."""
    @F.pandas_udf("array<string>")
    def tags(forms: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(forms), batch):
            part = [list(x) for x in forms.iloc[at : at + batch]]
            made = tagger(part)
            if [len(x) for x in made] != [len(x) for x in part]:
                raise ValueError("the tagger's output doesn't match the tokens")
            out += made
        return pd.Series(out, index=forms.index)

    from ..operators.matching import misc_upsert

    tagged = sentences.withColumn("_tags", tags(F.transform("tokens", lambda t: t["form"])))
    keys = [c for c in sentences.columns if c != "tokens"]
    return generated(tagged, keys, tokens=F.zip_with("tokens", "_tags", lambda t, x: t.withField("misc", misc_upsert(t["misc"], x)))).select(*sentences.columns)


def merge_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """The blocks of a treebank's splits in that order, as ``(split, file, ord, lines)``; each must be just one file, or one folder of part files as Spark writes them."""
    out = None
    for i, split in enumerate(splits):
        names = matching(spark, f"{folder}/*-{split}.conllu{{,.gz}}")
        if len(names) != 1:
            raise ValueError(f"{folder}: {split} has {len(names)} files")
        part = blocks(spark, names[0]).withColumn("split", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.select("split", "file", "ord", "lines")


def chunk_ids(blocks_: DataFrame, most_bytes: int, by: str = "file") -> DataFrame:
    """Blocks with the number of the chunk of ``by`` that each falls into, in the order of ``ord``.

    A block counts its lines with their ends, not the blank line after it. A chunk closes at the
    block with which it holds ``most_bytes`` or more, and the next starts empty.
    """
    size = F.octet_length(F.array_join("lines", "\n")) + 1
    return greedy_chunks(blocks_, by, F.col("ord"), size, most_bytes)


def write_chunks(blocks_: DataFrame, path: str, most_bytes: int = 50 << 20, by: str = "file", **options: str) -> None:
    """Writes a file for each chunk, as ``name=.../chunk=n/``, blocks in order: each holds at least ``most_bytes``, by one block at
    most, but for the last of ``by``, which may hold less. ``options`` are the text sink's."""
    named = chunk_ids(blocks_, most_bytes, by).withColumn("name", F.regexp_extract(by, r"([^/]*?)(\.conllu)?(\.gz)?$", 1))
    rows = named.repartition("name", "chunk").sortWithinPartitions("name", "chunk", "ord")
    rows.select("name", "chunk", F.array_join("lines", "\n").alias("value")).write.partitionBy("name", "chunk").options(**({"lineSep": "\n\n"} | options)).text(path)
