"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Documents are tokenized in Arrow batches and cut into pieces. How pieces combine depends on their lengths
only, so the packing is planned on the histogram of lengths (at most ``capacity`` numbers, whatever the
corpus): per bin, bitset subset-sum dynamic programming over the lengths still available finds the fullest
feasible combination with the longest piece left; that pattern is then removed as often as the counts allow.
Pieces are numbered within their length and take their places in the pattern instances by that number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace, python_stage, free_shuffles, only, with_rank

CAPACITY = 2048
END_ID = 0
#: Bytes of words and ids that a worker keeps from task to task.
CACHE_BYTES = 32 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Fixed values of a tokenizer that lower-cases, drops white space and then splits like this; its words are encoded one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of its own between the words of one call, and words of a call's text.
MARK, CALL_WORDS = "\x01", 500


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, a batch at a time.

    If the tokenizer splits at white space before anything else (see ``SPLIT``), a text's ids are its words'
    ids in order: Arrow cuts a batch at ASCII white space and numbers its distinct words, the tokenizer sees
    the words that are not known yet, many in one call with a mark between them, and the ids are gathered by
    number. Any other tokenizer, and a text with the mark or the string of an added token, encodes the whole
    text. Known words are kept as Arrow and numpy columns; beyond ``cache_bytes`` only those of the last batch stay.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alone = [MARK, *(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
        first = steps[0] if steps else {}
        mark = self.whole(MARK)
        self.by_word = first.get("pattern") == {"Regex": SPLIT} and bool(first.get("invert")) and kinds == ["NFC", "Replace", "Lowercase"] and not made.get("post_processor") and len(mark) == 1
        self.mark, self.limit = mark[:1], cache_bytes
        self._keep(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _keep(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.known, self.ids, self.size = words, ids, size

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        import pyarrow.compute as pc

        ends = np.append(np.arange(0, len(words), CALL_WORDS), len(words)).astype(np.int32)
        calls = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), f" {MARK} ").to_pylist()
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)]
        ids = np.concatenate([x for e in found for x in (e, self.mark)])
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known words, and where those of each of the distinct ``words`` start and how many there are."""
        import pyarrow.compute as pc

        at = pc.index_in(words, self.known)
        new = words.filter(at.is_null())
        if len(new):
            ids, size = self._encoded(new)
            was, fresh = len(self.known), at.is_null().to_numpy(zero_copy_only=False)
            self._keep(pa.concat_arrays([self.known, new]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size]))
            number = at.fill_null(0).to_numpy().copy()
            number[fresh] = was + np.arange(len(new))
        else:
            number = at.to_numpy()
        ids, size, first = self.ids, self.size[number], (np.cumsum(self.size) - self.size)[number]
        if self.known.nbytes + ids.nbytes + self.size.nbytes > self.limit:
            kept = np.sort(number)
            n = self.size[kept]
            self._keep(self.known.take(pa.array(kept)), ids[_ranges((np.cumsum(self.size) - self.size)[kept], n)], n)
        return ids, first, size

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a batch; null is empty."""
        import pyarrow.compute as pc

        said = pc.fill_null(texts, "")
        texts = pc.ascii_lower(said)
        alone = np.full(len(texts), not self.by_word)
        for token in self.alone:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if alone.any():
            texts = pc.if_else(pa.array(alone), "", texts)
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        ids, first, size = self._look_up(numbered.dictionary)
        number = numbered.indices.to_numpy()
        count = size[number]
        out = ids[_ranges(first[number], count)]
        ends = np.append(0, np.cumsum(count))[np.cumsum(pc.list_value_length(split).to_numpy())]
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            yield self.whole(said[k].as_py()) if alone[k] else out[a:b]

    def encode(self, text: str) -> bytes:
        return next(self.batch(pa.array([text], pa.string()))).tobytes()


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    past = np.cumsum(count)
    kind = np.int32 if len(past) and max(int(past[-1]), int(first.max())) < 1 << 31 else np.int64
    return np.repeat((first - past + count).astype(kind), count) + np.arange(past[-1] if len(past) else 0, dtype=kind)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task; a function of this module, so that its globals are not pickled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Null text is empty: a piece of the end id alone."""
    python_stage(docs.sparkSession)
    names, kinds = [f.split()[0] for f in PIECES.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = encoder_for(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1)), strict=True):
                ids = found.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        pa.default_memory_pool().release_unused()  # the worker stays, other stages share its memory

    return only(docs, id, text).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each available length fill ``room`` best; of equal fills one of few long pieces."""
    lengths = sorted(x for x, n in counts.items() if n and x <= room)
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        steps.append(reach)
        left, k = min(counts[x], room // x), 1
        while left:  # binary splitting of the multiplicity
            k = min(k, left)
            reach |= (reach << (k * x)) & mask
            left, k = left - k, 2 * k
    fill, chosen = reach.bit_length() - 1, {}
    for x, before in zip(reversed(lengths), reversed(steps), strict=True):
        n = min(counts[x], fill // x)
        while n and not before >> (fill - n * x) & 1:
            n -= 1
        if n:
            chosen[x] = n
            fill -= n * x
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) and how often each is used; together they hold the histogram exactly."""
    counts, out = {x: n for x, n in histogram.items() if n}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        pattern = fullest(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((pattern, times))
    return out


class Seats:
    """Where a piece goes, from its length and its number among the pieces of that length.

    A row per pattern and length, sorted: at most as many patterns as there are lengths, for each exhausts one,
    of a few dozen lengths each. A piece finds its row by binary search.
    """

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for x, n in sorted(pattern.items(), reverse=True):
                rows.append((x, used.get(x, 0), sequence, n, offset))
                used[x] = used.get(x, 0) + n * times
                offset += n * x
            sequence += times
        made = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
        self.key, (self.first, self.sequence, self.many, self.at) = self._key(made[0], made[1]), made[1:]

    @staticmethod
    def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length << 44) + number

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place in it of each piece."""
        row = np.searchsorted(self.key, self._key(length, number), side="right") - 1
        inside = number - self.first[row]
        return self.sequence[row] + inside // self.many[row], self.at[row] + inside % self.many[row] * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` are cut. Null and empty texts hold the end id alone. Repeated
    rows are packed as often as they stand there; pieces that tie are interchangeable, so equal lengths may
    swap places between runs on other partitions. A very long text is cut into as many pieces as it needs; the
    worker holds its ids once. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    cut = space.save(pieces(docs, tokenizer, capacity, end_id, text, id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    seats = Seats(plan(histogram, capacity))
    ranked = with_rank(cut, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], [F.col("doc_id"), F.col("piece")], sum(histogram.values()), "_rank")
    free_shuffles(spark)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, rank = batch.columns
            found = seats.of(kept[3].to_numpy(), rank.to_numpy())
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(seat, f"{PIECES}, sequence_id long, offset long")
