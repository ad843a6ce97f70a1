"""Harmonic packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents
from tessella.llm.textkernel import mapped

CAPACITY = 2048
END_ID = 1
#: The share of a slot that may stay empty before a piece is cut.
MAX_WASTE = 1 / 48
#: Pieces of at most so many ids are never cut.
SMALL = 45
TOKENIZER = "word_bpe_49k.json"
#: Parts of words that a worker keeps at most.
CACHED_PARTS = 500_000

# In texts without any but these characters lower case is by character and nothing composes.
_OTHER = "[^\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
# How the tokenizer cuts a text into parts, for such characters.
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Recent:
    """A bounded store in two generations; what is asked for again outlives what is not."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not held; the others are at hand until the next call."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        fresh = keys.difference(self.new)
        if self.old:
            again = fresh.intersection(self.old)
            self.new.update(zip(again, map(self.old.__getitem__, again)))
            fresh -= again
        return list(fresh)


class PartEncoder:
    """Ids of whole texts, by way of the parts into which the tokenizer cuts them.

    Each part is encoded once while it is remembered; ids are the same as the
    tokenizer's for the whole text.  Texts with special tokens' strings or with
    characters beyond Latin-1 letters go through the tokenizer as they are.
    """

    def __init__(self, path: str, cached: int = CACHED_PARTS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.lean = Tokenizer.from_file(path)
        self.odd = "|".join([_OTHER, *(re.escape(t.content) for t in self.lean.get_added_tokens_decoder().values())])
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.lean.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = _Recent(cached)

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is, for texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, parts: list[str]) -> None:
        known = self.parts.new
        for low in range(0, len(parts), 2048):
            some = parts[low : low + 2048]
            ids = np.array(self.lean.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            at = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(at) != len(some) + 1:
                raise ValueError("the tokenizer does not mark the ends of words as expected")
            flat = ids.tobytes()
            known.update(zip(some, [flat[a:b] for a, b in zip(at, at[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # one look at all texts for what must go through the tokenizer as it is
        odd = pa.compute.match_substring_regex(pa.array(texts, pa.large_string()), self.odd).to_pylist()
        cut = [None if o else _PARTS.findall(t.lower()) for t, o in zip(texts, odd)]
        self._learn(self.parts.missing(set().union(*(c for c in cut if c))))
        get = self.parts.new.__getitem__
        whole = [t for t, c in zip(texts, cut) if c is None]
        direct = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        return [np.array(next(direct).ids, "<u4").tobytes() if c is None else b"".join(map(get, c)) for c in cut]


class WholeEncoder:
    """Ids of whole texts by the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


# Texts that tell tokenizers apart: contractions, digits, signs, accents, case, white space, scripts, long words.
_PROBES = (
    "", " ", "Hello, world! It's 3.14; don't we'll 've", "a1b2c3 x_y-z (A) [B]", "tab\tline\n\n  two  spaces ", "Ärger über naïve Éclairs, ñandú ß", "ÀÖØ×÷ «q» ¿qué?",
    "日本語 текст Σίσυφος", "word" * 60, "!!! ... --- ###", "12345 1,000.50 0x1F", "<s></s> <|endoftext|> [CLS] <pad>", "O'Brien's 'quoted' \"text\"", "e\u0301 \u2028 \u00a0 x",
)


@lru_cache
def parts_agree(path: str) -> bool:
    """Whether the parts of texts, encoded apart, have the ids that this tokenizer gives to whole texts."""
    try:
        return PartEncoder(path, 1000).encode(list(_PROBES)) == WholeEncoder(path).encode(list(_PROBES))
    except (ValueError, KeyError):
        return False


def cuts(tokens: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``tokens`` ids, in order.

    Class j has j slots of ``capacity // j``.  A piece that would leave more
    than ``max_waste`` of its slot empty is cut to fill a slot of the next class.
    """
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        j = capacity // rest
        slot = capacity // j
        if rest > SMALL and slot - rest > max_waste * slot:
            j += 1
            out.append((capacity // j, j))
            rest -= capacity // j
        else:
            out.append((rest, j))
            rest = 0
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every task packs the documents it reads, by itself: no row moves.  Pieces
    of class j, of lengths over capacity / (j + 1) up to capacity / j, go j to a
    sequence.  What is left in unfilled bins at the end of a task is laid end
    to end and cut at the capacity, so that each task pads one such sequence.
    A sequence's id has the task's number in its upper bits.

    Texts are encoded part by part where the tokenizer is one whose parts can
    be (``parts_agree``, on texts that tell tokenizers apart), else whole.

    A null or empty text has the end id only.  Repeated rows are packed each by
    itself.  An empty table gives an empty one; further columns are not read.
    """
    path = tokenizer or public_file(TOKENIZER)
    by_parts = parts_agree(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder(path) if by_parts else WholeEncoder(path)
        base = TaskContext.get().partitionId() << 32
        number = 0
        bins: dict[int, list] = {}
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
            out, size = [], 0
            return batch

        def close(pieces: list[tuple]) -> None:
            nonlocal number, size
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, ids, total, base + number, offset))
                offset += n
                size += len(ids)
            number += 1

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids_of), 512):
                part = [t or "" for t in texts.slice(low, 512).to_pylist()]
                for doc, ids in zip(ids_of[low : low + 512], encoder.encode(part)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length, j in cuts(total, capacity):
                        piece = (doc, start, ids[4 * start : 4 * (start + length)], total)
                        start += length
                        if j == 1:
                            close([piece])
                            continue
                        held = bins.setdefault(j, [])
                        held.append(piece)
                        if len(held) == j:
                            close(bins.pop(j))
                if size > 8_000_000:
                    yield flush()
        row, room = [], capacity
        for j in sorted(bins):
            for doc, start, ids, total in bins[j]:
                while ids:
                    part = ids[: 4 * room]
                    row.append((doc, start, part, total))
                    ids, start, room = ids[4 * room :], start + len(part) // 4, room - len(part) // 4
                    if not room:
                        close(row)
                        row, room = [], capacity
        if row:
            close(row)
        if out:
            yield flush()

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return mapped(columns, run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: str | None = None
