"""Repeated passages by suffix arrays: every byte covered by a string of LENGTH bytes that an
earlier document holds too is found, over whole texts.

1. Each window of LENGTH bytes has an anchor: its K-byte gram of least hash. Equal windows have
   equal anchors, so only windows whose anchor recurs in another document can repeat; grams are
   counted in hash buckets, pre-aggregated by batch.
2. The stretches around recurring anchors are dealt by anchor into shards. A shard is sorted by
   Larsson-Sadakane refinement (groups that are not yet single are sorted again by the rank of
   the suffix twice as far on), common prefixes come from Kasai's walk, and runs of LENGTH or
   more give each window the least document that holds it. Where an anchor's bucket needs
   several shards, the sorted windows of one are looked up in the others by binary search.
3. Covered stretches are merged by document.

Bytes travel as compressed arrays, one row for each batch and bucket. Anchors of very many
documents are dealt by the window's own content instead, so no bucket grows with one of them.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import buckets, free_shuffles, partitions, stage

LENGTH, K = 50, 24
WINDOWS = LENGTH - K + 1
#: The longest stretch whose windows share an anchor.
STRETCH = LENGTH + WINDOWS - 1
#: Bytes hashed at a time, text gathered into a batch, stretches sorted in one shard.
CHUNK, BATCH, SHARD = 1 << 20, 24 << 20, 40_000
#: Documents that make an anchor hot, and how many hot anchors are dealt apart (the most frequent).
HOT, HOT_ANCHORS = 20_000, 50_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; ids, which mostly ascend, as differences."""
    if "id" in arrays:
        arrays["id"] = np.diff(arrays["id"], prepend=0)
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return arrays | {"id": np.cumsum(arrays["id"])}


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n places, as one integer."""
    return np.array(np.ndarray((n,), "<u8", data, strides=(1,)))


def anchors(data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and last window of each maximal run of windows that share one.

    ``room`` has for each byte how many are left in its document; windows stay inside one.
    """
    n = len(data) - K + 1
    if n < WINDOWS:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    words = _words(data, len(data) - 7)
    h = words[:n] * _ODD[0] + (words[8 : 8 + n] ^ np.uint64(0x5851F42D4C957F2D)) * _ODD[1]
    h = (h ^ (h >> np.uint64(32))) * _ODD[2] + words[16 : 16 + n] * _ODD[3]
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    low = np.uint64(63)
    h = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    least = h
    for shift in (1, 2, 4, 8, WINDOWS - 16):
        least = np.minimum(least[:-shift], least[shift:])
    starts = np.flatnonzero(room[: len(least)] >= LENGTH)
    least = least[starts]
    at = starts + (((least & low).astype(np.int64) - starts) & 63)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut]) if len(at) else cut
    last = np.concatenate([cut - 1, [len(at) - 1]]) if len(at) else cut
    return least[first] >> np.uint64(6), starts[first], starts[last]


class Docs:
    """A batch of documents: ids, text keys and bytes."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.keys: list[int] = []
        self.texts: list[bytes] = []
        self.extra: list = []
        self.size = 0

    def add(self, doc_id: int, key: int, text: bytes, extra=None) -> None:
        self.ids.append(doc_id)
        self.keys.append(key)
        self.texts.append(text)
        self.extra.append(extra)
        self.size += len(text)

    def scan(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For each chunk: bytes, then hash, document, first and last window (in the chunk) and the chunk's
        offset in that document, of each anchor run."""
        piece, owner, offset, held = [], [], [], 0
        for i, text in enumerate(self.texts):
            for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
                part = text[at : at + CHUNK + LENGTH - 1]
                piece.append(part)
                owner.append(i)
                offset.append(at)
                held += len(part)
                if held >= CHUNK:
                    yield self._anchored(piece, owner, offset)
                    piece, owner, offset, held = [], [], [], 0
        if piece:
            yield self._anchored(piece, owner, offset)

    @staticmethod
    def _anchored(piece: list[bytes], owner: list[int], offset: list[int]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(piece), np.uint8)
        sizes = np.fromiter(map(len, piece), np.int64, len(piece))
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(data))
        h, first, last = anchors(data, room)
        which = np.searchsorted(ends, first, side="right")
        return data, h, np.array(owner)[which], first, last, np.array(offset)[which] - (ends - sizes)[which]


def _batches(stream, width: int) -> Iterator[Docs]:
    docs = Docs()
    for batch in stream:
        columns = [batch.column(i).to_pylist() for i in (0, 1)] + [batch.column(2)] + [batch.column(i) for i in range(3, width)]
        for i, (doc_id, key, text) in enumerate(zip(*columns[:3], strict=True)):
            docs.add(doc_id, key, text.as_py() or b"", [c[i].as_py() for c in columns[3:]])
            if docs.size >= BATCH:
                yield docs
                docs = Docs()
    if docs.ids:
        yield docs


def _rows(made: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, blob in made:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _dealt(bucket: np.ndarray, base: int, **arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed row for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    if not len(held):
        return
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    for lo, hi in zip(starts, [*starts[1:], len(held)], strict=True):
        part = order[lo:hi]
        yield base + int(held[lo]), _pack(**{k: v[part] for k, v in arrays.items()})


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _ODD[1]) >> np.uint64(40)).astype(np.int64) % n


def _grams(docs: Docs, n: int, m: int) -> Iterator[tuple[int, bytes]]:
    """Distinct anchors of a batch with their documents counted; those of two documents here go to these at once."""
    found = [(h, d) for _, h, d, *_ in docs.scan()]
    if not found:
        return
    h, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d = h[fresh], d[fresh]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(starts, len(h)))
    ids = np.array(docs.ids, np.int64)
    order = np.lexsort((h[starts], d[starts]))  # by document, for short differences
    one, of, count_of = h[starts][order], d[starts][order], count[order]
    low, high = one.astype(np.uint32), (one >> np.uint64(32)).astype(np.uint16)
    yield from _dealt((one % np.uint64(n)).astype(np.int64), 0, low=low, high=high, n=count_of.astype(np.int32), id=ids[of])
    again = np.flatnonzero(np.repeat(count > 1, count))
    again = again[np.argsort(d[again], kind="stable")]
    yield from _dealt(_doc_bucket(ids[d[again]], m), n, h=h[again].astype(np.uint32), id=ids[d[again]])


def _recurring(blobs: list[bytes], n: int, m: int) -> list[tuple[int, bytes]]:
    """Anchors of two documents or more, to the documents that are alone with them in their batch; and the hot ones.

    Anchors are told apart by 48 bits here: a chance agreement costs a needless look, no result.
    """
    parts = [_unpack(b) for b in blobs]
    low, high, count, ids = (np.concatenate([p[k] for p in parts]) for k in ("low", "high", "n", "id"))
    h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    _, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, weights=count).astype(np.int64)[inverse]
    on = np.flatnonzero((total > 1) & (count == 1))
    on = on[np.argsort(ids[on], kind="stable")]
    rows = [*_dealt(_doc_bucket(ids[on], m), n, h=low[on], id=ids[on])]
    hot, at = np.unique(h[total > HOT], return_index=True)
    if len(hot):
        rows.append((n + m, _pack(id=hot.view(np.int64), n=total[total > HOT][at])))
    return rows


def _by_document(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, ids))
    i, k = ids[order], keys[order]
    return order, np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))


def _stretches(docs: Docs, hot: np.ndarray, n: int, m: int) -> Iterator[tuple[int, bytes]]:
    """The distinct stretches of a batch around recurring anchors, each with its least document; other documents
    that hold the same stretch are covered at once."""
    got: list[tuple[np.ndarray, ...]] = []
    for data, h, d, first, last, shift in docs.scan():
        on = np.zeros(len(h), bool)
        starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(d)], strict=True):
            known = np.frombuffer(docs.extra[d[lo]][0], np.uint32)
            spot = np.searchsorted(known, x := h[lo:hi].astype(np.uint32))
            on[lo:hi] = known[np.minimum(spot, len(known) - 1)] == x
        h, d, first, last, shift = (x[on] for x in (h, d, first, last, shift))
        size, bucket = last - first + LENGTH, h % np.uint64(n)
        apart = np.isin(h & np.uint64((1 << 48) - 1), hot)
        if apart.any():  # every window by itself, dealt by its content
            each = np.repeat(np.flatnonzero(apart), (last - first + 1)[apart])
            step = np.arange(len(each)) - np.repeat(np.cumsum((last - first + 1)[apart]) - (last - first + 1)[apart], (last - first + 1)[apart])
            stay = np.flatnonzero(~apart)
            take = np.concatenate([stay, each])
            first = np.concatenate([first[stay], first[each] + step])
            size = np.concatenate([size[stay], np.full(len(each), LENGTH)])
            d, shift = d[take], shift[take]
            content = sum((_words(data, len(data) - 7)[first[len(stay) :] + k] * _ODD[i % 4] + _ODD[(i + 1) % 4]) * np.uint64(2 * i + 3) for i, k in enumerate((0, 8, 16, 24, 32, 40, 42)))
            bucket = np.concatenate([bucket[stay], (content >> np.uint64(20)) % np.uint64(n)])
        if not len(first):
            continue
        wide = np.concatenate([data, np.zeros(STRETCH, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(wide, STRETCH)[first]
        rows = rows * (np.arange(STRETCH)[None, :] < size[:, None])
        got.append((rows.astype(np.uint8), size.astype(np.uint8), d, first + shift, bucket.astype(np.int64)))
    if not got:
        return
    rows, size, d, start, bucket = (np.concatenate(x) for x in zip(*got, strict=True))
    ids, keys = np.array(docs.ids, np.int64), np.array(docs.keys, np.int32)
    same = _alike(rows, size)
    order = np.lexsort((start, ids[d], same))
    heads = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
    least = np.empty(same.max() + 1, np.int64)
    least[same[heads]] = ids[d[heads]]
    # What the least document holds goes to the shards, at every place it stands; later documents have it covered.
    mine = ids[d] == least[same]
    kept = np.flatnonzero(mine)
    yield from _dealt(bucket[kept], 0, rows=rows[kept], size=size[kept], id=ids[d[kept]], key=keys[d[kept]], start=start[kept])
    later = np.flatnonzero(~mine)
    yield from _dealt(_doc_bucket(ids[d[later]], m), n, id=ids[d[later]], key=keys[d[later]], start=start[later], end=start[later] + size[later])


def _alike(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each row, equal where rows are."""
    joined = np.ascontiguousarray(np.concatenate([rows, size[:, None]], axis=1))
    _, inverse = np.unique(joined.view(f"V{joined.shape[1]}").ravel(), return_inverse=True)
    return inverse


def suffix_array(text: np.ndarray, n: int) -> np.ndarray:
    """The order of the n suffixes of ``text[:n]`` (Larsson-Sadakane); 8 or more zeros follow them."""
    keys = np.array(np.ndarray((n,), ">u8", text, strides=(1,))).astype(np.uint64)
    order = np.argsort(keys).astype(np.int32)
    fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    far = 8
    while True:
        group = rank[order]
        single = np.concatenate([group[1:] != group[:-1], [True]]) & (group == places)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        held = order[open_]
        next_ = held.astype(np.int64) + far
        beyond = np.where(next_ < n, rank[np.minimum(next_, n - 1)], n - 1 - next_)  # past the end: the shorter first
        key = group[open_].astype(np.int64) << 32 | (beyond + far)
        turn = np.argsort(key)
        held, key = held[turn], key[turn]
        order[open_] = held
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[held] = np.maximum.accumulate(np.where(fresh, open_, 0)).astype(np.int32)
        far *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int, most: int = LENGTH) -> np.ndarray:
    """What each suffix shares with the one before it in ``order``, up to ``most`` (Kasai).

    The text is rows of ``width`` bytes; all rows are walked together, each suffix starting from
    what the one a byte before it shared, less one.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    shared, out = np.zeros(n // width, np.int64), np.empty(n, np.uint8)
    for column in range(width):
        here = np.arange(column, n, width)
        there = before[here]
        shared = np.where(there < 0, 0, np.maximum(shared - 1, 0))
        live = np.flatnonzero((there >= 0) & (shared < most))
        while len(live):
            live = live[text[here[live] + shared[live]] == text[there[live] + shared[live]]]
            shared[live] += 1
            live = live[shared[live] < most]
        out[here] = shared
    return out[order]


class Shard:
    """The windows of a set of distinct stretches, each with the least document that holds it."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, least: np.ndarray) -> None:
        n = rows.size
        self.text = np.concatenate([rows.ravel(), np.zeros(2 * LENGTH, np.uint8)])
        order = suffix_array(self.text, n)
        shared = common_prefixes(self.text, order, STRETCH)
        run = np.cumsum(shared < LENGTH)
        is_window = (np.arange(STRETCH)[None, :] <= size[:, None].astype(np.int64) - LENGTH).ravel()
        on = is_window[order]
        self.order, run = order[on], run[on]
        self.starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        self.least = np.minimum.reduceat(least[self.order // STRETCH], self.starts)
        self.shape = rows.shape

    def keys(self) -> np.ndarray:
        """The distinct windows in sorted order; a last byte keeps trailing NULs."""
        rows = np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[self.order[self.starts]]
        return np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], axis=1).view(f"S{LENGTH + 1}").ravel()

    def merge(self, other: Shard, mine: np.ndarray, theirs: np.ndarray) -> None:
        """Gives both shards the lesser document for every window they share."""
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        both = np.flatnonzero(theirs[at] == mine)
        low = np.minimum(self.least[both], other.least[at[both]])
        self.least[both] = low
        other.least[at[both]] = low

    def by_place(self) -> np.ndarray:
        """The least document of each place that starts a window, by stretch; elsewhere the largest number."""
        out = np.full(self.shape[0] * STRETCH, np.iinfo(np.int64).max)
        out[self.order] = np.repeat(self.least, np.diff(np.append(self.starts, len(self.order))))
        return out.reshape(self.shape)


def _covered(blobs: list[bytes], n: int, m: int) -> list[tuple[int, bytes]]:
    """What the stretches of a bucket cover, to the documents' buckets."""
    parts = [_unpack(b) for b in blobs]
    rows, size, ids, keys, start = (np.concatenate([p[k] for p in parts]) for k in ("rows", "size", "id", "key", "start"))
    same = _alike(rows, size)
    order = np.lexsort((ids, same))
    heads = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]  # by ``same``: 0, 1, ...
    least = ids[heads]
    shards = []
    for lo in range(0, len(heads), SHARD):
        part = heads[lo : lo + SHARD]
        shards.append(Shard(rows[part], size[part], least[lo : lo + SHARD]))
    if len(shards) > 1:
        sorted_keys = [s.keys() for s in shards]
        for i, a in enumerate(shards):  # a window's last shard gets the least from its first, and the others from its last
            for j in range(i + 1, len(shards)):
                a.merge(shards[j], sorted_keys[i], sorted_keys[j])
    low, high = np.empty(len(heads), np.int64), np.empty(len(heads), np.int64)
    for i, s in enumerate(shards):
        cut = slice(i * SHARD, i * SHARD + s.shape[0])
        earlier = s.by_place() < least[cut][:, None]
        none = ~earlier.any(axis=1)
        low[cut] = np.where(none, -1, earlier.argmax(axis=1))
        high[cut] = STRETCH - 1 - earlier[:, ::-1].argmax(axis=1) + LENGTH
    later = ids > least[same]
    begin = np.where(later, start, start + low[same])
    end = np.where(later, start + size, start + high[same])
    on = later | (low[same] >= 0)
    return [*_dealt(_doc_bucket(ids[on], m), n, id=ids[on], key=keys[on], start=begin[on], end=end[on])]


def _routed(df: DataFrame, n: int, m: int, parts: int, work: Callable[[list[bytes], int, int], list[tuple[int, bytes]]]) -> DataFrame:
    """Buckets below n are worked; the others hold results already and pass."""

    def run(group):
        bucket, blobs = group["bucket"][0].as_py(), group["blob"].to_pylist()
        return _table([(bucket, b) for b in blobs] if bucket >= n else work(blobs, n, m))

    return df.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "bucket int, blob binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.hash("text").alias("_key"), F.col("text").cast("binary").alias("_text"))


def spans(docs: DataFrame) -> DataFrame:
    """``(_id, _key, _starts, _ends)``: the maximal covered runs of each document that has any, in bytes.

    ``_key`` is a hash of the text, which tells rows apart that repeat a doc_id with another text.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs).where("_id is not null and _text is not null")
    n, parts = buckets(keyed), partitions(keyed)
    m = max(8, n // 8)  # for documents, whose rows are few

    def grams(stream):
        for batch in _batches(stream, 3):
            yield from _rows(_grams(batch, n, m))

    def known(group):
        if group["bucket"][0].as_py() == n + m:
            parts = [_unpack(b) for b in group["blob"].to_pylist()]
            return _known_table([(int(i), int(k), None) for p in parts for i, k in zip(p["id"], p["n"], strict=True)])
        parts = [_unpack(b) for b in group["blob"].to_pylist()]
        h, ids = (np.concatenate([p[k] for p in parts]) for k in ("h", "id"))
        order, starts = _by_document(ids, np.zeros_like(ids))
        return _known_table([(int(ids[order[lo]]), None, np.unique(h[order[lo:hi]]).tobytes()) for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True)])

    counted = _routed(keyed.mapInArrow(grams, "bucket int, blob binary"), n, m, parts, _recurring)
    candidates = stage(counted.groupBy("bucket").applyInArrow(known, "cid long, seen long, grams binary"), "suffix-candidates")
    del counted
    free_shuffles(spark)
    hot_rows = candidates.df.where("grams is null").orderBy(F.desc("seen"), "cid").limit(HOT_ANCHORS).select("cid").toPandas()
    hot = np.sort(hot_rows["cid"].to_numpy(np.int64).view(np.uint64)) if len(hot_rows) else np.empty(0, np.uint64)
    with_grams = candidates.df.where("grams is not null")
    told = keyed.join(with_grams, F.col("_id") == F.col("cid")).select("_id", "_key", "_text", "grams")

    def stretches(stream):
        for batch in _batches(stream, 4):
            yield from _rows(_stretches(batch, hot, n, m))

    def joined(group):
        parts = [_unpack(b) for b in group["blob"].to_pylist()]
        ids, keys, start, end = (np.concatenate([p[k] for p in parts]) for k in ("id", "key", "start", "end"))
        order, starts = _by_document(ids, keys)
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            a, b = _union(start[order[lo:hi]], end[order[lo:hi]])
            rows.append((int(ids[order[lo]]), int(keys[order[lo]]), a.tolist(), b.tolist()))
        columns = [*zip(*rows, strict=True)] or [[], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(["_id", "_key", "_starts", "_ends"], columns, kinds, strict=True)})

    covered = _routed(told.mapInArrow(stretches, "bucket int, blob binary"), n, m, parts, _covered)
    made = stage(covered.groupBy("bucket").applyInArrow(joined, "_id long, _key int, _starts array<long>, _ends array<long>"), "suffix-spans")
    candidates.release()
    del told, covered
    free_shuffles(spark)
    return made.df


def _known_table(rows: list[tuple]) -> pa.Table:
    columns = [*zip(*rows, strict=True)] or [[], [], []]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(["cid", "seen", "grams"], columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)})


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]


def cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """``text`` without the given runs."""
    kept, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _with_spans(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of ``docs`` beside its text in bytes and its covered runs (null if none)."""
    found = spans(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.hash("text").alias("_key"), F.col("text").cast("binary").alias("_text"), *columns)
    found = found.withColumnsRenamed({"_id": "_sid", "_key": "_skey"})
    return keyed.join(found, (F.col("_id") == F.col("_sid")) & (F.col("_key") == F.col("_skey")), "left")


def removals(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256.

    A byte is removed if a string of LENGTH bytes over it also starts in a document of smaller
    doc_id; strings are judged on the input. Null texts are empty. Rows without a doc_id are
    left whole and cover nothing; rows of one doc_id don't cover one another, and rows that
    repeat one whole are cut alike. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, a, b in zip(*[batch.column(i) for i in range(4)], strict=True):
                text, a, b = text.as_py() or b"", a.as_py() or [], b.as_py() or []
                rows.append((doc_id.as_py(), len(text), sum(b) - sum(a), len(a), a, b, hashlib.sha256(cut(text, a, b)).hexdigest()))
            columns = [*zip(*rows, strict=True)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.string()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string"
    return _with_spans(docs).select("_id", "_text", "_starts", "_ends").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered bytes cut out of ``text`` and ``n_chars`` counted again; other columns as they came.

    Characters of which only some bytes are covered go whole. Null texts stay null.
    """
    schema = docs.schema
    kept = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            texts = []
            for text, a, b in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                texts.append(cut(text.as_py(), a.as_py() or [], b.as_py() or []).decode("utf-8", "ignore") if text.is_valid else None)
            row = batch.column(3)
            columns = []
            for i, name in enumerate(kept):
                if name == "text":
                    columns.append(pa.array(texts, pa.string()))
                elif name == "n_chars":
                    columns.append(pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(row.field(i).type))
                else:
                    columns.append(row.field(i))
            yield pa.RecordBatch.from_arrays(columns, kept)

    whole = F.struct(*[(F.lit(None).cast("string") if c == "text" else F.col(f"`{c}`")).alias(c) for c in kept]).alias("_row")
    return _with_spans(docs, whole).select("_text", "_starts", "_ends", "_row").mapInArrow(run, schema)
