"""Substring deduplication with suffix arrays: every byte of a window that also starts in a smaller document goes.

1. Texts are packed into source shards, a row of about 2 MB each. Windows of ``LENGTH`` bytes are routed by
   their minimizer, the least hash among the k-mers inside: equal windows have equal minimizers, so they meet
   in one content shard however far apart their documents lie, and neighbouring windows share a minimizer, so
   they travel together as one run. A first exchange of minimizers alone finds those that occur in two
   documents, and those with so many different runs that their windows are routed one by one instead, each
   by its own hash: no content shard holds a frequent minimizer as a whole.
2. Only runs at shared minimizers travel as bytes; byte-equal ones of a source shard travel once, with their
   least document, and are laid together once more where they meet.
3. A content shard is cut into pieces of ``ARRAY_BYTES``, and each piece becomes a suffix array
   (Larsson-Sadakane refinement: groups of equal prefixes are split by the ranks of the suffixes behind, the
   depth doubling, settled groups left alone). Kasai's recurrence gives the common prefixes of neighbours;
   stretches of at least ``LENGTH`` in common are the equal windows. Where the cut between two pieces falls
   among the runs of one minimizer, their sorted windows are merged by binary search. So every decision on a
   window is read off the suffix arrays, and then told to the source shards that asked.

Bytes and documents move in packed columns, so no stage makes a row per window.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, free_shuffles, only, python_stage

LENGTH, K = 50, 16
#: Bytes of a source shard, of a content shard (by input), and of one suffix array.
SHARD_BYTES, BUCKET_BYTES, ARRAY_BYTES = 2 << 20, 8 << 20, 1 << 20
#: Windows of a run at most, windows looked at together, and different runs from which on a minimizer is taken apart.
RUN, CHUNK, HOT_RUNS = 64, 1 << 20, 20_000
#: Content shards up to which each is dealt to a task of its own.
MOST_KEYS = 1 << 16
#: Bits of a minimizer's hash; two that share it cost a comparison, nothing else.
HASH_BITS = 48
#: Sorts behind all documents: rows without an id remove nothing elsewhere.
NO_ID = np.iinfo(np.int64).max
M1, M2, M3, M4, BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D))


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte place by byte place, so that their high zero bytes take no room once squeezed."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


class Reader:
    """Takes columns off a blob in the order in which they were put there."""

    def __init__(self, blob: bytes):
        self.data, self.at = expand(blob), 0

    def take(self, kind: type, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        out = np.frombuffer(self.data, np.uint8, size * n, self.at).reshape(size, n).T.copy().view(kind).ravel()
        self.at += size * n
        return out


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    past = np.cumsum(count)
    return np.repeat(first - past + count, count) + np.arange(past[-1] if len(past) else 0)


def words64(data: bytes) -> np.ndarray:
    """The little-endian 64-bit word at each byte; 64 zero bytes are appended, so every position has its words."""
    padded = data + bytes(72)
    return np.ndarray(shape=(len(data) + 64,), dtype="<u8", buffer=padded, strides=(1,))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, by which a sum over a stretch of bytes is made independent of its place."""
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64)))) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


class Runs:
    """Runs of windows with one minimizer: its hash, document number, first window, number of windows, hash of the bytes.

    With ``shared`` (ascending minimizers) only runs at those; windows at ``hot`` ones stand alone, under their own hash.
    """

    def __init__(self, data: bytes, ends: np.ndarray, shared: np.ndarray | None = None, hot: np.ndarray | None = None, chunk: int = CHUNK):
        parts = [self._of(data[a : a + chunk + LENGTH - 1], a, ends, shared, hot) for a in range(0, max(0, len(data) - LENGTH + 1), chunk)]
        parts.append(tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)))
        self.hash, self.doc, self.first, self.count, self.mark = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _of(data: bytes, base: int, ends: np.ndarray, shared: np.ndarray | None, hot: np.ndarray | None) -> tuple[np.ndarray, ...]:
        n, u = len(data) - LENGTH + 1, words64(data)
        mixed = u[: len(data) - 7] * M1
        mixed ^= mixed >> np.uint64(31)
        h = u[8 : len(data) - K + 9] * M2
        h += mixed[: len(h)]
        h ^= h >> np.uint64(29)
        h *= M3
        span, least, width = 1, h, LENGTH - K + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(least[1:n], least[: n - 1], out=new[1:])
        cuts = np.concatenate([ends, np.maximum(ends - LENGTH + 1, np.append(0, ends[:-1]))]) - base  # windows that would cross into the next document
        new[cuts[(cuts > 0) & (cuts < n)]] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        if count.max() > RUN:
            pieces = -(-count // RUN)
            inside = ranges(np.zeros_like(pieces), pieces) * RUN
            first, count = np.repeat(first, pieces) + inside, np.minimum(np.repeat(count, pieces) - inside, RUN)
        doc = np.searchsorted(ends, base + first, side="right")
        h = (least[first] * M4) >> np.uint64(64 - HASH_BITS)
        keep = base + first + LENGTH <= ends[doc]
        if shared is not None:
            keep &= _among(h, shared)
        h, doc, first, count = h[keep], doc[keep], first[keep], count[keep]
        single = _among(h, hot) if hot is not None and len(hot) else np.zeros(len(h), bool)
        if single.any():
            alone = ranges(first[single], count[single])
            doc = np.concatenate([doc[~single], np.repeat(doc[single], count[single])])
            first, h = np.concatenate([first[~single], alone]), np.concatenate([h[~single], np.zeros(len(alone), np.uint64)])
            count = np.concatenate([count[~single], np.ones(len(alone), np.int64)])
        power, inverse = _powers(max(len(mixed), CHUNK + LENGTH) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * power[: len(mixed)])))
        mark = (sums[first + count + LENGTH - 8] - sums[first]) * inverse[first]
        mark ^= mark >> np.uint64(32)
        mark *= M4
        h = np.where(np.arange(len(h)) < len(h) - (len(alone) if single.any() else 0), h, mark >> np.uint64(64 - HASH_BITS))
        return h, doc, base + first, count, mark & np.uint64(0xFFFF)


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def laid_together(data: bytes, hashes: np.ndarray, mark: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the byte strings by (hash, mark), stable, and which of them in it differ from the one before.

    Strings told apart here may still be equal (when marks collide); those taken together are, byte by byte.
    """
    key = (hashes << np.uint64(16)) | mark
    order = np.argsort(key, kind="stable")
    key, at, size, u = key[order], at[order], size[order], words64(data)
    same = (key[1:] == key[:-1]) & (size[1:] == size[:-1])
    for k in range(0, int(size.max(initial=0)), 8):
        live = np.flatnonzero(same & (size[1:] > k))
        off = np.minimum(k, size[live + 1] - 8)
        same[live] = u[at[live + 1] + off] == u[at[live] + off]
    return order, np.concatenate(([True], ~same))[: len(order)]


def suffix_array(data: bytes) -> np.ndarray:
    """All suffixes in order. The order must be complete: Kasai's recurrence does not hold for one cut at a depth."""
    n = len(data)
    key = words64(data)[:n].byteswap()
    order = np.argsort(key)
    key = key[order]
    rank = np.full(n + 1, -1, dtype=np.int64)
    head = np.ones(n + 1, dtype=bool)  # one more: the end closes the last group
    head[1:n] = key[1:] != key[:-1]
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    have = 8
    open_ = np.flatnonzero(~(head[:n] & head[1:]))
    while len(open_):
        at = order[open_]
        group, past = rank[at], at + have
        behind = np.where(past < n, rank[np.minimum(past, n)], n - 1 - past)  # beyond the end: the shorter suffix first
        by = np.argsort(group * (4 * n) + behind + 2 * n)
        at, group, behind = at[by], group[by], behind[by]
        order[open_] = at
        head[open_[1:]] = (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])
        rank[at] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        open_ = open_[~(head[open_] & head[open_ + 1])]
        have *= 2
    return order


def common_prefixes(data: bytes, order: np.ndarray, limit: int = LENGTH, lanes: int = 8192) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in order, up to ``limit``.

    The recurrence (a suffix shares at least one byte less than the suffix a byte earlier did) runs in text
    order over many stretches of the text side by side; words are compared, not bytes.
    """
    n = len(data)
    u = words64(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    stretch = max(1, -(-n // lanes))
    i = np.arange(0, n, stretch)
    have = np.zeros(len(i), dtype=np.int64)
    for _ in range(stretch):
        if len(i) and i[-1] >= n:
            i, have = i[:-1], have[:-1]
        j = before[i]
        have = np.where(j < 0, 0, np.maximum(have - 1, 0))
        live = np.flatnonzero((j >= 0) & (have < limit))
        while len(live):
            x = u[i[live] + have[live]] ^ u[j[live] + have[live]]
            # the lowest bit that differs, exact as a power of two, tells how many bytes agree
            have[live] += np.where(x == 0, 8, (np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1) >> 3)
            live = live[(x == 0) & (have[live] < limit)]
        have = np.minimum(have, np.minimum(limit, n - np.maximum(i, np.maximum(j, 0))))
        out[i] = have
        i = i + 1
    return out[order]


class SuffixShard:
    """The suffix array of one piece: per window of its runs the class, classes numbered in the order of their bytes."""

    def __init__(self, data: bytes, at: np.ndarray, size: np.ndarray, count: np.ndarray, doc: np.ndarray):
        """Runs start at ``at`` in ``data`` and have ``count`` windows; ``doc`` is their least document."""
        src = np.frombuffer(data, np.uint8)
        self.bytes = src[ranges(at, size)].tobytes()
        order = suffix_array(self.bytes)
        name = np.empty(len(order), dtype=np.int64)
        name[order] = np.cumsum(common_prefixes(self.bytes, order) < LENGTH) - 1
        self.first = np.cumsum(count) - count  # of each run's windows
        self.place = ranges(np.cumsum(size) - size, count)
        self.name = name[self.place].astype(np.int32)
        self.least = np.full(int(self.name.max(initial=-1)) + 1, NO_ID, dtype=np.int64)
        np.minimum.at(self.least, self.name, np.repeat(doc, count))

    def prefixes(self, first: int, past: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows from ``first`` to ``past``: their classes, ascending, and their bytes, which ascend too."""
        classes, k = np.unique(self.name[first:past], return_index=True)
        at = self.place[first + k]
        cells = np.frombuffer(self.bytes, np.uint8)[at[:, None] + np.arange(LENGTH)]
        closed = np.concatenate([cells, np.full((len(at), 1), 1, np.uint8)], axis=1)  # numpy drops zero bytes at the end of a string
        return classes, np.ascontiguousarray(closed).view(f"S{LENGTH + 1}").ravel()


def merge(parts: list[tuple[SuffixShard, np.ndarray, np.ndarray]]) -> None:
    """Give equal windows of several suffix arrays (shard, classes, bytes) their least document, by binary search."""
    shard, classes, known = parts[0]
    least = shard.least[classes]
    for shard, classes, wanted in parts[1:]:
        at = np.searchsorted(known, wanted)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == wanted[hit]
        np.minimum.at(least, at[hit], shard.least[classes[hit]])
        known, least = np.insert(known, at[~hit], wanted[~hit]), np.insert(least, at[~hit], shard.least[classes[~hit]])
    for shard, classes, wanted in parts:
        shard.least[classes] = least[np.searchsorted(known, wanted)]


def classes_of(data: bytes, hashes: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run (in the order of hashes) where its windows start in a list of least documents, and that list."""
    count, past = size - LENGTH + 1, np.cumsum(size)
    cuts = np.unique(np.searchsorted(past, np.arange(0, int(past[-1]) + piece, piece), side="left"))
    cuts[-1] = len(size)
    shards = [(a, b, SuffixShard(data, at[a:b], size[a:b], count[a:b], doc[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
    shared: dict[int, list] = {}
    for k, (a, b, shard) in enumerate(shards):  # a minimizer whose runs lie in several pieces
        for h in {int(hashes[a]), int(hashes[b - 1])}:
            if (k and h == int(hashes[a - 1])) or (k + 1 < len(shards) and h == int(hashes[b])):
                lo, hi = np.searchsorted(hashes[a:b], np.uint64(h), "left"), np.searchsorted(hashes[a:b], np.uint64(h), "right")
                windows = np.append(shard.first, len(shard.name))
                shared.setdefault(h, []).append((shard, *shard.prefixes(int(windows[lo]), int(windows[hi]))))
    for parts in shared.values():
        if len(parts) > 1:
            merge(parts)
    return np.cumsum(count) - count, np.concatenate([shard.least[shard.name] for _, _, shard in shards])


def _shards(docs: DataFrame) -> DataFrame:
    """One row per source shard: shard (hash of its content), ids, ends, data."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def row(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
            i, ends, data = np.array(ids, dtype=np.int64).tobytes(), np.cumsum([len(t) for t in texts]).astype(np.int64).tobytes(), squeeze(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(i + ends + data)]), *(pa.array([x], pa.binary()) for x in (squeeze(i), squeeze(ends), data)), pa.array([sum(map(len, texts))], pa.int64())], names=["shard", "ids", "ends", "data", "size"])

        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(NO_ID if doc is None else doc)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= SHARD_BYTES:
                    yield row(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield row(ids, texts)

    return docs.mapInArrow(pack, "shard string, ids binary, ends binary, data binary, size long")


def _shard(batch: pa.RecordBatch, i: int) -> tuple[str, np.ndarray, np.ndarray, bytes]:
    return (batch.column(0)[i].as_py(), np.frombuffer(expand(batch.column(1)[i].as_py()), np.int64), np.frombuffer(expand(batch.column(2)[i].as_py()), np.int64), expand(batch.column(3)[i].as_py()))


def _by_bucket(hashes: np.ndarray, bits: int, keys: np.ndarray) -> list[tuple[int, slice]]:
    """Keys and slices of ascending hashes by their top bits."""
    bucket = (hashes >> np.uint64(HASH_BITS - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(keys[bucket[a]]), slice(int(a), int(b))) for a, b in zip(np.append(0, cut), np.append(cut, len(bucket)), strict=True) if b > a]


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """A key for each of ``n`` content shards, so that hash partitioning deals one to each of ``n`` tasks.

    Beyond ``MOST_KEYS`` shards the numbers themselves: so many fall evenly enough by their hash.
    """
    keys = np.arange(n, dtype=np.int64)
    if 1 < n <= MOST_KEYS:
        found = spark.range(n * (int(np.log(n)) + 8)).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id"))
        keys = -1 - keys  # for what is not found
        for r in found.collect():  # a row per task
            keys[r["p"]] = r["id"]
    return keys


def _rows(rows: list[tuple], bucketed: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary()) if bucketed else (pa.string(), pa.int64(), pa.binary())
    names = ["bucket", "shard", "blob"] if bucketed else ["shard", "bucket", "blob"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _minimizers(shards: DataFrame, bits: int, keys: np.ndarray) -> DataFrame:
    """Per source and content shard: the minimizers, each with its least document, whether it has more than one, and its different runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, ids, ends, data = _shard(batch, k)
                runs = Runs(data, ends)
                if not len(runs.hash):
                    continue
                key = (runs.hash << np.uint64(16)) | runs.mark
                by = np.argsort(key)
                key, doc = key[by], ids[runs.doc[by]]
                h = key >> np.uint64(16)
                start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
                forms = np.add.reduceat(np.append(True, key[1:] != key[:-1]).astype(np.uint32), start, dtype=np.uint32)
                h = h[start]
                yield _rows([(b, shard, squeeze(np.uint64(s.stop - s.start).tobytes() + planes(h[s]) + planes(least[s]) + planes(least[s] != most[s]) + planes(forms[s]))) for b, s in _by_bucket(h, bits, keys)], True)

    return shards.mapInArrow(run, "bucket long, shard string, blob binary")


def _shared(table: pa.Table) -> pa.Table:
    """Of one content shard's minimizers those that occur in two documents, per source shard, and which of them are hot."""
    parts = []
    for blob in table.column("blob"):
        r = Reader(blob.as_py())
        n = int(np.frombuffer(r.data, np.uint64, 1)[0])
        r.at = 8
        parts.append((r.take(np.uint64, n), r.take(np.int64, n), r.take(np.bool_, n), r.take(np.uint32, n)))
    h, doc, more, forms = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum([len(p[0]) for p in parts])
    by = np.argsort(h)
    hs = h[by]
    start = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
    several = np.logical_or.reduceat(more[by], start) | (np.minimum.reduceat(doc[by], start) != np.maximum.reduceat(doc[by], start))
    hot = np.add.reduceat(forms[by], start, dtype=np.int64) >= HOT_RUNS
    keep, split = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    size = np.diff(np.append(start, len(h)))
    keep[by], split[by] = np.repeat(several, size), np.repeat(hot, size)
    shard, bucket = table.column("shard").to_pylist(), table.column("bucket")[0].as_py()
    rows = []
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        at = a + np.flatnonzero(keep[a:b])
        if len(at):
            rows.append((shard[i], bucket, squeeze(np.uint64(len(at)).tobytes() + planes(h[at]) + planes(split[at]))))
    return pa.Table.from_batches([_rows(rows, False)])


class Forms:
    """The runs of a source shard at shared minimizers; runs of equal bytes are one form, numbered in a fixed order."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, data: bytes, lists: list[bytes]):
        shared, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for blob in lists:
            r = Reader(blob)
            n, r.at = int(np.frombuffer(r.data, np.uint64, 1)[0]), 8
            shared.append(r.take(np.uint64, n))
            hot.append(r.take(np.bool_, n))
        h, split = np.concatenate(shared), np.concatenate(hot)
        runs = Runs(data, ends, np.sort(h), np.sort(h[split]))
        by, new = laid_together(data, runs.hash, runs.mark, runs.first, runs.count + LENGTH - 1)
        self.doc, self.first, self.count, self.form = ids[runs.doc[by]], runs.first[by], runs.count[by], np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.hash, self.mark = runs.hash[by][start], runs.mark[by][start]
        self.at, self.size = self.first[start], self.count[start] + LENGTH - 1
        self.least = np.minimum.reduceat(self.doc, start) if len(start) else self.doc


def _forms(joined: DataFrame, bits: int, keys: np.ndarray) -> DataFrame:
    """Per source and content shard: minimizers, marks, least documents, lengths and bytes of the different runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, ids, ends, data = _shard(batch, k)
                f = Forms(ids, ends, data, batch.column(4)[k].as_py() or [])
                text = np.frombuffer(data, np.uint8)
                for b, s in _by_bucket(f.hash, bits, keys):
                    yield _rows([(b, shard, squeeze(np.array([s.stop - s.start, s.start], np.uint64).tobytes() + planes(f.hash[s]) + planes(f.least[s]) + f.mark[s].astype(np.uint16).tobytes() + f.size[s].astype(np.uint8).tobytes() + text[ranges(f.at[s], f.size[s])].tobytes()))], True)

    return joined.mapInArrow(run, "bucket long, shard string, blob binary")


def _decided(table: pa.Table) -> pa.Table:
    """Decisions of one content shard: for each source shard, windows of its forms' least documents that go.

    Packed as number of entries, form, first window and windows of each.
    """
    parts, texts = [], []
    for blob in table.column("blob"):
        r = Reader(blob.as_py())
        n, base = np.frombuffer(r.data, np.uint64, 2).astype(np.int64).tolist()
        r.at = 16
        h, doc = r.take(np.uint64, n), r.take(np.int64, n)
        mark, size = np.frombuffer(r.data, np.uint16, n, r.at), np.frombuffer(r.data, np.uint8, n, r.at + 2 * n)
        parts.append((h, doc, mark.astype(np.uint64), size.astype(np.int64), base + np.arange(n)))
        texts.append(r.data[r.at + 3 * n :])
    ends = np.cumsum([len(p[0]) for p in parts])
    h, doc, mark, size, number = (np.concatenate(x) for x in zip(*parts, strict=True))
    data, at = b"".join(texts), np.cumsum(size) - size
    del parts, texts
    by, new = laid_together(data, h, mark, at, size)
    start = np.flatnonzero(new)
    form = np.empty(len(h), dtype=np.int64)
    form[by] = np.cumsum(new) - 1
    one = by[start]
    first, least = classes_of(data, h[one], at[one], size[one], np.minimum.reduceat(doc[by], start), ARRAY_BYTES)
    rows = []
    shard, bucket = table.column("shard").to_pylist(), table.column("bucket")[0].as_py()
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        count = size[a:b] - LENGTH + 1
        goes = least[ranges(first[form[a:b]], count)] < np.repeat(doc[a:b], count)
        if not goes.any():
            continue
        past = np.cumsum(count)
        edge = np.zeros(len(goes) + 1, bool)
        edge[past - count] = edge[-1] = True
        begin = np.flatnonzero(goes & (edge[:-1] | ~np.append(False, goes[:-1])))
        end = np.flatnonzero(goes & (edge[1:] | ~np.append(goes[1:], False)))
        entry = np.searchsorted(past, begin, side="right")
        rows.append((shard[i], bucket, squeeze(np.uint64(len(begin)).tobytes() + planes(number[a:b][entry]) + (begin - (past - count)[entry]).astype(np.uint8).tobytes() + (end - begin + 1).astype(np.uint8).tobytes())))
    return pa.Table.from_batches([_rows(rows, False)])


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary, kept_sha256 string"


def _gone(f: Forms, size: int, answers: list[bytes]) -> np.ndarray:
    """Which bytes of a source shard go."""
    later = f.doc > f.least[f.form] if len(f.form) else np.zeros(0, bool)
    starts, windows = [f.first[later]], [f.count[later]]
    told = [np.zeros((3, 0), np.int64)]
    for blob in answers:
        r = Reader(blob)
        n, r.at = int(np.frombuffer(r.data, np.uint64, 1)[0]), 8
        told.append(np.stack([r.take(np.int64, n), np.frombuffer(r.data, np.uint8, n, r.at).astype(np.int64), np.frombuffer(r.data, np.uint8, n, r.at + n).astype(np.int64)]))
    form, first, count = (t := np.concatenate(told, axis=1))[:, np.argsort(t[0], kind="stable")]
    own = np.flatnonzero(~later)
    lo, hi = np.searchsorted(form, f.form[own], "left"), np.searchsorted(form, f.form[own], "right")
    at = ranges(lo, hi - lo)
    starts.append(np.repeat(f.first[own], hi - lo) + first[at])
    windows.append(count[at])
    a = np.concatenate(starts)
    b = a + np.concatenate(windows) + LENGTH - 1
    return np.cumsum(np.bincount(a, minlength=size + 1)[:size] - np.bincount(b, minlength=size + 1)[:size]) > 0


def _cut(joined: DataFrame, with_text: bool) -> DataFrame:
    """Per document what goes and what stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, ends, data = _shard(batch, k)
                f = Forms(ids, ends, data, batch.column(4)[k].as_py() or [])
                gone = _gone(f, len(data), batch.column(5)[k].as_py() or [])
                removed = np.diff(np.append(0, np.cumsum(gone))[np.append(0, ends)]).tolist()
                view, out, a = np.frombuffer(data, np.uint8), [], 0
                for doc, b, n in zip(ids.tolist(), ends.tolist(), removed, strict=True):
                    kept, spans = data[a:b] if not n else b"", []
                    if n:
                        g = gone[a:b]
                        kept = view[a:b][~g].tobytes()
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))).tolist()
                        spans = [{"start": x, "length": y - x} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    out.append((None if doc == NO_ID else doc, b - a, n, spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string()))],
                                                 names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, with_text: bool = True, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: the columns of ``RESULT``; ``kept`` is the remaining bytes (null without ``with_text``).

    A byte goes if a window of ``LENGTH`` bytes over it also starts in a document with a smaller id; windows
    are judged on the input. Null and empty texts have no bytes. Rows that share an id do not remove from
    each other; a row without an id removes nothing elsewhere. Each row gives one row; an empty table an
    empty result. A text of any length is one row of a source shard: a worker holds it with a few bytes of
    marks per byte, and looks at its windows ``CHUNK`` at a time. Other columns are not read.
    """
    spark = docs.sparkSession
    python_stage(spark)
    space = Workspace(spark, "suffix")
    shards = space.save(_shards(only(docs, id, text)), "shards")
    total = shards.agg(F.sum("size")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES)))))
    parts = 1 << bits  # tasks grow in number with the input and not in size
    keys = even_keys(spark, parts)
    shared = space.save(_minimizers(shards, bits, keys).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_shared, "shard string, bucket long, blob binary"), "shared")
    free_shuffles(spark)
    shards = shards.repartition(parts, "shard")
    lists = shared.repartition(parts, "shard").groupBy("shard").agg(F.sort_array(F.collect_list("blob")).alias("shared"))
    joined = shards.join(lists, "shard")
    decided = space.save(_forms(joined.select("shard", "ids", "ends", "data", "shared"), bits, keys).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_decided, "shard string, bucket long, blob binary"), "decided")
    free_shuffles(spark)
    answers = decided.repartition(parts, "shard").groupBy("shard").agg(F.collect_list("blob").alias("decided"))
    last = shards.drop("size").join(lists, "shard", "left").join(answers, "shard", "left").select("shard", "ids", "ends", "data", F.coalesce("shared", F.array().cast("array<binary>")).alias("shared"), "decided")
    return _cut(last, with_text)


def substring_table(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
