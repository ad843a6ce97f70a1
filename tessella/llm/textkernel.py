"""Array kernels over whole batches of texts: words, shingles, XXH64, bit votes.

The bytes of many texts lie end to end in one array; nothing is done by row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessella.session import ship

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def text_slices(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + most_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


#: A batch that goes to a Python worker has no more bytes than this, but for single rows that are larger.
BATCH_BYTES = 8 << 20


def _frugal() -> Callable[[], None]:
    """Have the C library hand large blocks straight back; returns what makes it give up all it still holds."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # the size from which blocks are mapped by themselves
        return lambda: libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return lambda: None


def released(run: Callable) -> Callable:
    """``run`` over batches, after which the worker's memory goes back to the system: workers outlast their tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = _frugal()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim()

    return tidy


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows with texts: batches are bounded by bytes, in the engine and in its workers."""
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(released(run), schema)


class Words:
    """The words of some texts over one buffer in which single spaces stand between them.

    ``starts``, ``ends``: places of each word in ``buffer``; ``raw_starts``,
    ``raw_ends``: in ``raw``; ``first``: for each text the index of its first
    word, with the end of the last one behind.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
        body = _LOWER[raw] if lower else raw
        n = len(body)
        solid = ~_SPACES[body]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] = solid[edges]
        starts = np.flatnonzero(begin)
        self.first = np.searchsorted(starts, offsets).astype(np.int64)
        counts = np.diff(self.first)
        inner = np.ones(len(starts), dtype=bool)
        inner[self.first[:-1][counts > 0]] = False
        keep = solid.copy()
        gaps = starts[inner] - 1
        keep[gaps] = True
        places = np.cumsum(keep) - keep
        body = np.where(solid, body, np.uint8(0x20))[keep]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = solid[tails]
        ends = np.flatnonzero(last)
        self.raw_starts, self.raw_ends = starts, ends + 1
        self.starts = places[starts].astype(np.int64)
        self.ends = places[ends].astype(np.int64) + 1
        self.buffer = np.concatenate([body, np.zeros(8, np.uint8)])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths, and for each text the index of its first shingle.

        A text of fewer words has one shingle, its whole sequence; one without words has none.
        """
        counts = np.diff(self.first)
        number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        index = np.concatenate([[0], np.cumsum(number)])
        text = np.repeat(np.arange(len(counts)), number)
        word = self.first[:-1][text] + (np.arange(index[-1]) - index[:-1][text])
        end = word + np.minimum(counts[text], size) - 1
        starts = self.starts[word]
        return starts, self.ends[end] - starts, index


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_equal(lanes8: np.ndarray, lanes4: np.ndarray, raw: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    s = np.uint64(seed)
    done = 0
    with np.errstate(over="ignore"):
        if length >= 32:
            a = np.full(len(at), s + P1 + P2, np.uint64)
            b = np.full(len(at), s + P2, np.uint64)
            c = np.full(len(at), s, np.uint64)
            d = np.full(len(at), s - P1, np.uint64)
            while done + 32 <= length:
                a = _round(a, lanes8[at + done])
                b = _round(b, lanes8[at + done + 8])
                c = _round(c, lanes8[at + done + 16])
                d = _round(d, lanes8[at + done + 24])
                done += 32
            h = _rotl(a, 1) + _rotl(b, 7) + _rotl(c, 12) + _rotl(d, 18)
            for v in (a, b, c, d):
                h = (h ^ _round(np.uint64(0), v)) * P1 + P4
        else:
            h = np.full(len(at), s + P5, np.uint64)
        h = h + np.uint64(length)
        while done + 8 <= length:
            h = _rotl(h ^ _round(np.uint64(0), lanes8[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= length:
            h = _rotl(h ^ (lanes4[at + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        while done < length:
            h = _rotl(h ^ (raw[at + done].astype(np.uint64) * P5), 11) * P1
            done += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of ``buffer``, which has 8 bytes to spare at its end."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lanes8 = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    lanes4 = np.ndarray((len(buffer) - 3,), dtype="<u4", buffer=buffer, strides=(1,))
    order = np.argsort(np.minimum(lengths, 65535).astype(np.uint16), kind="stable")
    size = lengths[order]
    cuts = np.flatnonzero(np.diff(np.minimum(size, 65535))) + 1
    for part in np.split(order, cuts):
        length = int(lengths[part[0]])
        if len(part) < 24 or length >= 65535:
            for i in part.tolist():
                out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : starts[i] + lengths[i]].tobytes(), seed)
        else:
            out[part] = _xxh64_equal(lanes8, lanes4, buffer, starts[part], length, seed)
    return out


_LANES = np.zeros(256, np.uint64)
for _bit in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def majority(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes; zero without any.

    ``index`` bounds each text's run in ``hashes``.  Runs are cut at 255, within
    which eight counters fit in one 64-bit word.
    """
    n = len(index) - 1
    counts = np.diff(index)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = (counts[full] + 254) // 255
    at = np.concatenate([[0], np.cumsum(pieces)])
    owner = np.repeat(np.arange(len(full)), pieces)
    cut = index[:-1][full][owner] + 255 * (np.arange(at[-1]) - at[:-1][owner])
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        votes = np.add.reduceat(_LANES[octets[:, j]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(votes, at[:-1], axis=0)
        bits = (2 * total > counts[full][:, None]).astype(np.uint64)
        for k in range(8):
            out[full] |= bits[:, k] << np.uint64(8 * j + k)
    return out


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash out of each one."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
