"""CoNLL-U as a Python data source: ``spark.read.format("conllu")`` and ``readStream``, once ``register`` has run.

A file is read in byte ranges. A block belongs to the range that holds the start of the separator
line before it (the first block to the file's first range), so every range finds its own blocks
alone, by reading on to a separator. Files are opened through pyarrow, in stores that it knows;
gz files are one range each.

Options: ``path`` (or load's argument), ``rows`` ("sentences" or "tokens"), ``split`` (bytes of a
range), ``min_cols``, ``errors`` ("replace" or "ignore" for bytes that are no UTF-8), and
``pushdown`` ("true" where spark.sql.python.filterPushdown.enabled is). Only the columns and token
fields of the schema in force are made; ``.schema(...)`` with fewer is how columns are pruned.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..schema import TOKEN

SENTENCES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("comments", T.ArrayType(T.StringType())),
        T.StructField("tokens", T.ArrayType(TOKEN)),
        T.StructField("text", T.StringType()),
        T.StructField("is_fallback", T.BooleanType()),
    ]
)
TOKENS = T.StructType([T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), *TOKEN.fields])
#: The column of a row that each token field stands in, and fields that filters are pushed for.
COLUMN = {name: i for i, name in enumerate(TOKEN.names)}
PUSHED = ("form", "lemma", "upos", "xpos", "feats", "deprel", "deps", "misc")
SPLIT = 64 << 20
#: White space whose lines part blocks.
BLANK = b" \t\x0b\x0c\r\n"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    whole: bool


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path)


def listed(path: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, change time in ns)`` of the files at or below ``path``, by path; hidden ones and markers are left out."""
    from pyarrow import fs

    system, local = _open_store(path)
    info = system.get_file_info(local)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(local, recursive=True))
    prefix = path[: -len(local)] if path.endswith(local) else re.match("(?:[a-z0-9+.-]+:/*)?", path)[0]
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f"{prefix}{f.path}", f.size, f.mtime_ns or 0) for f in files)


def ranges(files: Sequence[tuple[str, int, int]], split: int) -> list[Range]:
    out = []
    for path, size, _ in files:
        if path.endswith(".gz"):
            out.append(Range(path, 0, size, True))
        else:
            out += [Range(path, a, min(a + split, size), False) for a in range(0, size, split)]
    return out


def read_blocks(part: Range) -> Iterator[tuple[int, list[bytes]]]:
    """``(offset, lines)`` of the blocks that belong to a range, lines without their ends."""
    system, local = _open_store(part.path)
    if part.whole:
        stream, at, end = io.BufferedReader(gzip.GzipFile(fileobj=system.open_input_stream(local, compression=None))), 0, None
    else:
        raw = system.open_input_file(local)
        at, end = part.start, part.end
        if at:
            raw.seek(at - 1)
        stream = io.BufferedReader(raw, 1 << 20)
        if at:
            at += len(stream.readline()) - 1  # the rest of the line that holds the byte before the range
    with stream:
        owned, block, begun = at == 0 and part.start == 0, [], 0
        while line := stream.readline():
            if not line.strip(BLANK):
                if block:
                    yield begun, block
                    block = []
                if end is not None and at >= end:
                    return
                owned = True
            elif owned:
                if not block:
                    begun = at
                block.append(line.removesuffix(b"\n").removesuffix(b"\r"))
            at += len(line)
        if block:
            yield begun, block


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options, self.wanted = schema, dict(options), []
        self.path = self.options.get("path")
        if not self.path:
            raise ValueError("conllu needs a path")
        self.by_token = self.options.get("rows", "sentences") == "tokens"
        self.min_cols, self.errors = int(self.options.get("min_cols", 8)), self.options.get("errors", "replace")

    def partitions(self) -> Sequence[Range]:
        return ranges(listed(self.path), int(self.options.get("split", SPLIT))) or [Range("", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        for place, raw in read_blocks(partition):
            yield from self.rows(partition.path, place, [x.decode("utf-8", self.errors) for x in raw])

    def rows(self, path: str, place: int, lines: list[str]) -> Iterator[tuple]:
        lines = [x.removeprefix("\ufeff") for x in lines]
        comments = [x for x in lines if x.startswith("#")]
        numbered = [f for x in lines if not x.startswith("#") and (f := x.split("\t"))[0].isascii() and f[0].isdigit()]
        if not numbered:
            return
        tokens = {int(f[0]): f for f in numbered if len(f) >= self.min_cols}  # the last row of an id
        if self.by_token:
            for i in sorted(tokens):
                f = tokens[i]
                if all(_cell(f, name) in values for name, values in self.wanted):
                    yield tuple(path if n == "file" else place if n == "place" else _cell(f, n) for n in self.schema.names)
            return
        said = next((x[9:] for x in comments if x.startswith("# text = ")), None)
        made = {"file": path, "place": place, "comments": comments, "text": said if said is not None else " ".join(f[1] if len(f) > 1 else "" for f in numbered), "is_fallback": said is None}
        if "tokens" in self.schema.names:
            fields = self.schema["tokens"].dataType.elementType.names
            made["tokens"] = [tuple(_cell(tokens[i], n) for n in fields) for i in sorted(tokens)]
        yield tuple(made[n] for n in self.schema.names)


def _cell(fields: list[str], name: str):
    at = COLUMN[name]
    x = fields[at] if at < len(fields) else None
    if name in ("id", "head"):
        return int(x) if x is not None and x.isascii() and x.isdigit() else 0
    return x


class FilteringReader(Reader):
    """Takes equality and membership on a token's fields; rows that fail them are never made."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if self.by_token and name in PUSHED:
                self.wanted.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """Files in the order of change time and path; an offset is the last one read. Files are whole when they appear and don't change."""

    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.reader = Reader(schema, options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def _after(self, offset: dict) -> list[tuple[str, int, int]]:
        return [f for f in listed(self.reader.path) if (f[2], f[0]) > (offset["changed"], offset["path"])]

    def latestOffset(self) -> dict:
        files = listed(self.reader.path)
        path, _, changed = max(files, key=lambda f: (f[2], f[0]), default=("", 0, -1))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        files = [f for f in self._after(start) if (f[2], f[0]) <= (end["changed"], end["path"])]
        return ranges(files, int(self.reader.options.get("split", SPLIT)))

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.reader.read(partition)


class ConlluSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conllu"

    def schema(self) -> T.StructType:
        return TOKENS if self.options.get("rows", "sentences") == "tokens" else SENTENCES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown", "false").lower() == "true" else Reader)(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConlluSource)
