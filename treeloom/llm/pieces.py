"""SentencePiece BPE encoding and decoding that keeps every piece's span in the source bytes.

The normaliser walks the model's compiled character map (a double-array trie) by longest
prefix and notes, for each normalised byte, the source byte it came from. Pieces are found in
the normalised text, so their ends map straight back through that alignment.

No piece of a supported model has a space mark after another character, so a text falls into
units (space marks, then other characters) that merge independently; characters that occur in
no longer piece part them further. Units repeat a lot and are remembered, within a bound; new
ones of several texts merge together, as rows of a matrix, one merge of each row at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
_MARK = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
#: Characters of the longest unit that is merged by looking through all its pairs, units merged together, and bytes of the texts they are gathered from.
SHORT, ROWS, GATHERED = 48, 4096, 1 << 20
#: The rank of a pair that makes no piece.
_NONE = np.iinfo(np.int32).max


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double array, then NUL-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest known prefix of ``data[at:]`` and that prefix's length."""
        units = self.units
        node, best = self._offset(units[0]), None
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[end]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, end + 1 - at
        if best is None:
            return None
        return self.strings[best[0] : self.strings.index(b"\0", best[0])], best[1]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normaliser:
    """Normalised text and, for each of its bytes (and its end), the source byte it stands for."""

    def __init__(self, spec, charsmap: bytes) -> None:
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if not spec.escape_whitespaces:
            raise ValueError("models that keep plain spaces are not supported")

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if self.map is None and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        source = np.frombuffer(data, np.uint8)
        at = np.repeat(np.arange(len(data), dtype=np.int32), np.where(source == 32, 3, 1))
        lead = 3 * self.dummy
        align = np.empty(lead + len(at) + 1, np.int32)
        align[:lead], align[lead:-1], align[-1] = 0, at, len(data)
        return _MARK * self.dummy + data.replace(b" ", _MARK), align

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts = list(self._prefixes(data))
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        out, align, after_space = bytearray(), [], self.squeeze
        start = parts[0][1] if parts else len(data)
        if parts and self.dummy:
            out += _MARK
            align += [start] * 3
        end = start
        for new, begin, stop in parts:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                marked = new.replace(b" ", _MARK)
                out += marked
                align += [begin] * len(marked)
                end = stop
                after_space = self.squeeze and new.endswith(b" ")
        while self.squeeze and out.endswith(_MARK):
            end = align[len(out) - 3]
            del out[-3:], align[-3:]
        return bytes(out), np.array([*align, end], np.int32)

    def _prefixes(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            new, size = found or (data[at : at + (n := _width(data, at))], n)
            yield new, at, at + size
            at += size


def _width(data: bytes, at: int) -> int:
    lead = data[at]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Units(dict):
    """Remembered units: text -> its ids as packed 32-bit integers. When full, they become the older ones, of which what is asked for again comes back."""

    BOUND = 300_000

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            parts = [x for x in self.codec.barrier.split(unit) if x]
            found = b"".join([self[x] for x in parts]) if len(parts) > 1 else self.codec.merge(unit)
        if len(unit) <= 64:
            self._room(1)
            self[unit] = found
        return found

    def _room(self, more: int) -> None:
        if len(self) + more > self.BOUND:
            self.older = dict(self)
            self.clear()

    def learn(self, units: set[str]) -> None:
        """Merges those of the units (and of their parts) together that are new and can be; the others are merged when they are asked for."""
        new = units.difference(self)
        fresh = new.difference(self.older)
        self.update((x, self.older[x]) for x in new - fresh)
        parts = {x for unit in fresh for x in self.codec.barrier.split(unit) if x}
        fresh = self.codec.plain(parts.difference(self, self.older))
        for at in range(0, len(fresh), ROWS):
            part = fresh[at : at + ROWS]
            self._room(len(part))
            self.update(zip(part, self.codec.merge_rows(part), strict=True))


class Codec:
    """A BPE model with byte fallback: ``encode``, ``decode`` and their string-level parts."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        trainer, spec = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models with byte fallback and leading space marks are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p: x for p, (x, _) in self.scores.items()}
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores):
            raise ValueError("a piece with an inner space mark joins units")
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        self.barrier = re.compile("([" + "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined) + "])")
        self.normalise = Normaliser(spec, spec.precompiled_charsmap)
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.units = Units(self)
        self._index_pairs()
        byte_of = {i: b for b, i in self.bytes_at.items()}
        #: For each id: its digits, its text, its bytes in normalised text, its byte if it stands for one above 127.
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.text = np.array([self._text(i, byte_of, trainer.unk_surface) for i in range(len(self.pieces))], object)
        self.size = np.array([1 if i in byte_of else len(p.encode()) for i, p in enumerate(self.pieces)], np.int64)
        self.high = np.array([byte_of.get(i, 0) & -(byte_of.get(i, 0) > 127) for i in range(len(self.pieces))], np.int16)

    def _text(self, i: int, byte_of: dict[int, int], unknown: str) -> str:
        if i in byte_of:
            return chr(byte_of[i])
        return {CONTROL: "", UNKNOWN: unknown}.get(self.kinds[i]) if self.kinds[i] != NORMAL else self.pieces[i].replace(MARK, " ")

    def _index_pairs(self) -> None:
        """The pairs of pieces that make a piece, as sorted keys (the last is none) with that piece and the rank of its score, equal for equal ones; the piece of each character."""
        self.of_character = np.full(0x110000, -1, np.int32)
        rank = {x: r for r, x in enumerate(sorted({x for x in self.score.values()}, reverse=True))}
        n, pairs = len(self.pieces) + 1, []  # one more: what fills rows up
        for p, (score, i) in self.scores.items():
            if len(p) == 1:
                self.of_character[ord(p)] = i
            for k in range(1, len(p)):
                if (a := self.scores.get(p[:k])) and (b := self.scores.get(p[k:])):
                    pairs.append((a[1] * n + b[1], i, rank[score]))
        keys, pieces, ranks = zip(*sorted(pairs), (np.iinfo(np.int64).max, -1, _NONE), strict=True)
        self.pair_keys, self.pair_pieces, self.pair_ranks = np.array(keys, np.int64), np.array(pieces, np.int32), np.array(ranks, np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the pairs, the last one if it makes no piece."""
        keys = left.astype(np.int64) * (len(self.pieces) + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    def plain(self, units: set[str]) -> list[str]:
        """Those of the units that ``merge_rows`` takes, shortest first: of SHORT characters at most, which are pieces all."""
        short = sorted((u for u in units if len(u) <= SHORT), key=len)
        if not short:
            return []
        known = self.of_character[np.frombuffer("".join(short).encode("utf-32-le"), "<u4")] >= 0
        starts = np.cumsum([0, *map(len, short)])[:-1]
        return list(compress(short, np.logical_and.reduceat(known, starts).tolist()))

    def merge_rows(self, units: list[str]) -> list[bytes]:
        """``merge`` of each, for units as ``plain`` gives them: each round merges every row's best pair."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width, order, out = int(sizes.max()), np.arange(len(units)), [b""] * len(units)
        rows = np.full((len(units), width), len(self.pieces), np.int32)
        rows[np.arange(width) < sizes[:, None]] = self.of_character[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        pairs = self._pairs(rows[:, :-1], rows[:, 1:])
        while True:
            own, at = np.arange(len(order)), np.zeros(len(order), int)
            live = np.zeros(len(order), bool)
            if pairs.shape[1]:
                ranks = self.pair_ranks[pairs]
                at = ranks.argmin(axis=1)  # the leftmost of the best
                live = ranks[own, at] < _NONE
            if not live.all():
                done = ~live
                packed = rows[done][np.arange(rows.shape[1]) < sizes[done][:, None]].astype("<i4").tobytes()
                ends = (4 * np.cumsum(sizes[done])).tolist()
                for i, low, high in zip(order[done].tolist(), [0, *ends], ends):
                    out[i] = packed[low:high]
                if not live.any():
                    return out
                rows, pairs, sizes, order, at = rows[live], pairs[live], sizes[live], order[live], at[live]
                own = np.arange(len(order))
            both, sizes, cols = self.pair_pieces[pairs[own, at]], sizes - 1, np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, cols + (cols > at[:, None]), axis=1)
            rows[own, at] = both
            pairs = np.take_along_axis(pairs, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
            some = np.flatnonzero(at > 0)
            pairs[some, at[some] - 1] = self._pairs(rows[some, at[some] - 1], both[some])
            some = np.flatnonzero(at < rows.shape[1] - 1)
            pairs[some, at[some]] = self._pairs(both[some], rows[some, at[some] + 1])

    def merge(self, unit: str) -> bytes:
        """Merges neighbours, best score first and leftmost among equals; packed ids."""
        parts = self._merge_short(list(unit)) if len(unit) <= SHORT else self._merge_long(list(unit))
        ids = []
        for piece in parts:
            if hit := self.scores.get(piece):
                ids.append(hit[1])
            else:
                ids += [self.bytes_at[b] for b in piece.encode()]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _merge_short(self, parts: list[str]) -> list[str]:
        score = self.score.get
        least = float("-inf")
        pairs = [score(a + b, least) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > least:
            i = pairs.index(best)
            parts[i : i + 2] = [both := parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + both, least)
            if i < len(pairs):
                pairs[i] = score(both + parts[i + 1], least)
        return parts

    def _merge_long(self, text: list[str]) -> list[str]:
        """The same by a queue, for units of many characters."""
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        queue: list = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (hit := self.score.get(text[i] + text[j])) is not None:
                heapq.heappush(queue, (-hit, i, j, text[i] + text[j]))

        for i in range(len(text) - 1):
            propose(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if right[i] != j or not text[i] or text[i] + text[j] != both:
                continue
            text[i], text[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            propose(left[i], i)
            propose(i, right[i])
        return [x for x in text if x]

    def split(self, normal: str) -> list[str]:
        """The units of a normalised text."""
        head, *rest = normal.split(MARK)
        if "" not in rest:
            units = [MARK + x for x in rest]
        else:
            units, run = [], 0
            for x in rest:
                run += 1
                if x:
                    units.append(MARK * run + x)
                    run = 0
            if run:
                units.append(MARK * run)
        return [head, *units] if head else units

    def encode_arrays(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text and each piece's end in its bytes; new units of all the texts are merged together."""
        made = []
        for data in texts:
            normal, align = self.normalise(data)
            made.append((self.split(normal.decode()), align))
        self.units.learn(set().union(*[units for units, _ in made]))
        for units, align in made:
            yield self._joined(units, align)

    def _joined(self, units: list[str], align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(map(self.units.__getitem__, units)), "<i4")
        ends = np.cumsum(self.size[ids])
        if self.high[ids].any():  # of the bytes of one character only the last spans it
            after = np.append(self.high[ids[1:]], 0)
            inner = (after >= 0x80) & (after < 0xC0)
            first = np.where(inner, 0, ends)
            whole = np.concatenate([[0], np.maximum.accumulate(first)[:-1]])
            ends = np.where(inner, whole, ends)
        return ids, align[ends]

    def encode(self, data: bytes) -> tuple[list[int], list[int], list[int]]:
        """ids, and the start and end of each piece in the source bytes."""
        return next(self.encoded([data]))

    def encoded(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """``encode`` of each."""
        for ids, ends in self.encode_arrays([_valid(x) for x in texts]):
            yield ids.tolist(), [0, *ends[:-1].tolist()][: len(ids)], ends.tolist()

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding put first."""
        ids = np.asarray(ids, np.int64)
        parts = self.text[ids].tolist()
        if self.high[ids].any():
            parts = self._bytes_joined(parts, ids)
        text = "".join(parts)
        first = next((i for i in ids.tolist() if self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK)
        return text[1:] if self.strip_first and marked else text

    def _bytes_joined(self, parts: list[str], ids: np.ndarray) -> list[str]:
        """Runs of byte pieces, read as UTF-8."""
        out, raw = [], bytearray()
        for part, i in zip(parts, ids.tolist(), strict=True):
            if self.kinds[i] == BYTE:
                raw.append(ord(part))
                continue
            if raw:
                out.append(_scan(bytes(raw)))
                raw.clear()
            out.append(part)
        return [*out, _scan(bytes(raw))] if raw else out


def _scan(raw: bytes) -> str:
    """UTF-8, each byte that starts no whole character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return _scan(data).encode()


@lru_cache(2)
def codec(model: bytes) -> Codec:
    """One codec for each model and worker process."""
    return Codec(model)


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[list[bytes]]:
    """The texts in their order, as many at a time as hold GATHERED bytes, one at least."""
    held, size = [], 0
    for x in batch.column(at):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= GATHERED:
            yield held
            held, size = [], 0
    yield held


def encode_documents(docs: DataFrame, model: bytes, digest: bool = False) -> DataFrame:
    """Encodes ``docs(doc_id, text)``; one row per input row.

    Without ``digest``: doc_id, ``ids``, ``starts``, ``ends`` (byte spans in the UTF-8 text) and
    ``decoded``. With it: doc_id, n_tokens and the SHA-256 of the ids joined by commas, of the
    decoded text and of the piece ends (little-endian 32-bit). Null and empty texts have no
    pieces; bytes that are not UTF-8 count as U+FFFD; repeated rows are encoded alike; other
    columns are ignored. A worker's memory is bounded by its largest text and twice Units.BOUND.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, of fixed size

    def run(batches):
        c = codec(shipped.value)
        for batch in batches:
            rows = [row for texts in _texts(batch, 1) for row in (_digests(c, texts) if digest else ((*x, c.decode(x[0])) for x in c.encoded(texts)))]
            columns = [*zip(*rows, strict=True)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    if digest:
        names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"], [pa.int64(), pa.string(), pa.string(), pa.string()]
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"
    else:
        names, kinds = ["ids", "starts", "ends", "decoded"], [pa.list_(pa.int32())] * 3 + [pa.string()]
        schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _digests(c: Codec, texts: list[bytes]) -> Iterator[tuple[int, str, str, str]]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for ids, ends in c.encode_arrays([_valid(x) for x in texts]):
        written = ",".join(map(c.digits.__getitem__, ids.tolist()))
        yield len(ids), sha(written.encode()), sha(c.decode(ids).encode()), sha(ends.astype("<i4").tobytes())
