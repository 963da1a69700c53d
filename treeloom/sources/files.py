"""TSV, JSON and binary files, the manifest and their contracts."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from .scratch import exists, remove, rename, statuses

#: The manifest's columns, those that must be filled, and the NER families.
MANIFEST = (
    "corpus_id", "display_name", "version", "source_input", "prepared_input", "preparation", "expected_sentences",
    "prepared_sha256", "syntax_layer", "ner_layer", "ner_family", "analyses", "compute_note", "notes",
)
REQUIRED = tuple(c for c in MANIFEST if c not in ("expected_sentences", "prepared_sha256"))
NER_FAMILIES = ("manual_ner", "automatic_ner", "not_used")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A TSV with a header, all strings, empty cells as null; the header must equal ``columns`` if given."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} has no header")
    names = header[0].lstrip("﻿").rstrip("\r").split("\t")
    if columns is not None and tuple(names) != tuple(columns):
        raise ValueError(f"{path}: expected columns {columns}, found {names}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote="", enforceSchema=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)


def read_keyed_tsv(spark: SparkSession, path: str, key: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """As ``read_tsv``; a key that occurs twice is an error."""
    df = read_tsv(spark, path, columns)
    if repeated := df.groupBy(key).count().where("count > 1").head(1):
        raise ValueError(f"{path}: {key} {repeated[0][0]!r} occurs {repeated[0][1]} times")
    return df


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A TSV with a header in one file of a directory that appears when it is whole (Spark's commit protocol)."""
    df.coalesce(1).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="", nullValue="", quote="", lineSep="\n")


def publish(spark: SparkSession, outputs: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
    """Writes several outputs as Parquet and lets them appear together.

    All are written beside their places first, ``check`` may refuse what it reads there, and only
    then are they renamed, one by one; nothing is overwritten. If one can't be renamed, those that
    were go again, so after a failure nothing has appeared (but for a reader in between).
    """
    if taken := [p for p in outputs if exists(spark, p)]:
        raise ValueError(f"{taken[0]} exists")
    staged = {p: f"{p}.{uuid.uuid4().hex}.tmp" for p in outputs}
    try:
        for path, df in outputs.items():
            df.write.parquet(staged[path])
        if check is not None:
            check({p: spark.read.parquet(t) for p, t in staged.items()})
        done = []
        try:
            for path, temporary in staged.items():
                rename(spark, temporary, path)
                done.append(path)
        except Exception:
            for path in done:
                remove(spark, path)
            raise
    finally:
        for temporary in staged.values():
            remove(spark, temporary)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """JSON documents, or with ``multi_line`` off a document a line (which splits)."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def manifest_violations(manifest: DataFrame, rows: int = 18) -> DataFrame:
    """``(corpus_id, rule)`` of all that is wrong with a manifest."""
    bad = []
    need = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"empty {c}")) for c in REQUIRED]))
    bad.append(manifest.select("corpus_id", F.explode(need).alias("rule")))
    for c in ("source_input", "prepared_input"):
        bad.append(manifest.where(F.col(c).startswith("/") | F.array_contains(F.split(c, "/"), "..")).select("corpus_id", F.lit(f"unsafe {c}")))
    bad.append(manifest.where(~F.coalesce(F.col("ner_family").isin(*NER_FAMILIES), F.lit(False))).select("corpus_id", F.lit("ner_family")))
    tags = F.transform(F.split("analyses", ","), lambda x: F.trim(x))
    bad.append(manifest.where(~F.array_contains(tags, "word_order")).select("corpus_id", F.lit("word_order is missing")))
    bad.append(manifest.groupBy("corpus_id").count().where("count > 1").select("corpus_id", F.lit("repeated")))
    bad.append(manifest.agg(F.count("*").alias("n")).where(F.col("n") != rows).select(F.lit(None).cast("string"), F.lit("number of rows")))
    out = bad[0]
    for b in bad[1:]:
        out = out.union(b)
    return out


def read_engine_result(spark: SparkSession, path: str) -> DataFrame:
    """``(pattern, n, trees)`` of an engine's table of linearised trees and their frequencies; '' for those that are no order."""
    from ..operators.matching import classify_linear

    rows = read_tsv(spark, path).select(classify_linear(F.col("Tree")).alias("pattern"), F.col("Absolute frequency").cast("long").alias("n"))
    return rows.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("trees"))


#: The columns of cached counts.
CACHED = ("corpus_id", "corpus", "pattern", "count", "total", "proportion")


def read_cached_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(corpus_id, corpus, pattern, n, total, proportion, places)`` of cached counts, typed; the header must be as it should.

    ``places`` is how many decimals a proportion is written with, 6 at least.
    """
    rows = read_tsv(spark, path, CACHED)
    places = F.greatest(F.lit(6), F.length(F.regexp_extract("proportion", r"^[0-9]*\.([0-9]+)$", 1)))
    return rows.select("corpus_id", "corpus", "pattern", F.col("count").cast("long").alias("n"), F.col("total").cast("long").alias("total"), F.col("proportion").cast("double").alias("proportion"), places.alias("places"))


def cache_violations(cached: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(corpus_id, rule)``: corpora the manifest lacks or names otherwise, and distributions that don't hold.

    Where ``cached`` has ``places``, proportions are held to as many decimals (12 at most, which doubles have for sure).
    """
    from ..operators.contracts import TOLERANCE, distribution_violations

    exact = TOLERANCE * F.pow(F.lit(10.0), 6 - F.least("places", F.lit(12))) if "places" in cached.columns else None
    names = cached.select("corpus_id", "corpus").distinct().join(manifest.select("corpus_id", "display_name"), "corpus_id", "left")
    foreign = names.where("display_name is null").select("corpus_id", F.lit("unexpected corpus").alias("rule"))
    other = names.where("display_name <> corpus").select("corpus_id", F.lit("display name"))
    return foreign.union(other).union(distribution_violations(cached, "corpus_id", exact))


def with_analysis(manifest: DataFrame, tag: str) -> DataFrame:
    return manifest.where(F.array_contains(F.transform(F.split("analyses", ","), lambda x: F.trim(x)), tag))


def inside(base: str, path: str) -> str:
    """``path`` under ``base``; absolute and escaping paths are errors."""
    if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
        raise ValueError(f"{path!r} leaves {base!r}")
    return os.path.join(base, path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(name, length, sha256)`` of each file of 2 GB at most; contents stay on the executors. ``streamed_digests`` has no limit."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def streamed_digests(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """``(name, length, sha256)`` of files of any size, read on the executors ``chunk`` bytes at a time, a task a file.

    Opened through pyarrow, so in stores that it knows (local, HDFS, S3, GCS); an empty file has
    the digest of nothing.
    """
    found = [(p, n) for p, n, _ in statuses(spark, path) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
    listed = spark.createDataFrame(found, "path string, length long")

    def run(frames):
        from pyarrow import fs

        for frame in frames:
            out = []
            for where, length in zip(frame["path"], frame["length"], strict=True):
                system, local = fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if re.match("file:/[^/]", where) else where)
                h = hashlib.sha256()
                with system.open_input_stream(local) as f:
                    while block := f.read(chunk):
                        h.update(block)
                out.append((where.rsplit("/", 1)[-1], length, h.hexdigest()))
            yield pd.DataFrame(out, columns=["name", "length", "sha256"])

    return listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "name string, length long, sha256 string")


def unchanged(spark: SparkSession, path: str, before: DataFrame | None = None):
    """Sizes and change times of files; with an earlier table, the files that differ from it."""
    now = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    if before is None:
        return now
    return now.exceptAll(before).union(before.exceptAll(now))


class Watch:
    """The files that a scan really read, as planned, to be held against the store once its rows have passed.

    A plan keeps the sizes and change times of its listing; rows carry them as they are read, and
    an observation gathers them, a row a file. ``check`` refuses the result if a file that was
    read has another size or change time by then, or is gone, or if the listing has other files.
    """

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.path, self.planned, self.seen = spark, path, statuses(spark, path), Observation(name)

    def check(self) -> list[tuple[str, int, int]]:
        """The files read; raises ``ChangedInput`` if they aren't those there are now."""
        read = sorted((r["path"], r["length"], r["changed"]) for r in self.seen.get["files"])
        plain = lambda rows: {(re.sub("^file:/+", "file:/", p), n, t) for p, n, t in rows}
        now = plain(statuses(self.spark, self.path))
        if missing := plain(read) - now:
            raise ChangedInput(f"changed while it was read: {min(missing)[0]}")
        if other := now ^ plain(self.planned):
            raise ChangedInput(f"changed since it was listed: {min(other)[0]}")
        return read


class ChangedInput(ValueError):
    """The input isn't what the scan was planned on."""


def watched(spark: SparkSession, path: str, read: Callable[[str], DataFrame], name: str = "files") -> tuple[DataFrame, Watch]:
    """``read(path)``, a scan of files, and a watch over it; the columns are the scan's."""
    watch, rows = Watch(spark, path, f"{name}-{uuid.uuid4().hex}"), read(path)
    meta = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.unix_millis("_metadata.file_modification_time").alias("changed"))
    marked = rows.select("*", meta.alias("_from")).observe(watch.seen, F.collect_set("_from").alias("files"))
    return marked.drop("_from"), watch


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and change times of the files at ``path``."""
    return hashlib.sha256(repr(statuses(spark, path)).encode()).hexdigest()
