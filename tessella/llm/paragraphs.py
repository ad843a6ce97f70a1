"""Passages that repeat across documents: paragraphs by MinHash banding and exact Jaccard, and equal runs of words wherever they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, materialize
from tessella.llm.exact_dedup import MAX_CELLS, filter_bits, filter_cells, marked_rows, maybe_shared, passes
from tessella.llm.graph import components
from tessella.llm.jaccard import band_hashes, bucket_links, buckets, groups_of, links_within, tuned_bands, unpacked, whole_runs
from tessella.llm.textkernel import Words, mapped, mix, released, text_slices, xxh64
from tessella.session import scratch

WORDS = 5
SIMILARITY = 0.8
#: Words of the shortest paragraph and of the shortest passage that are looked at.
MIN_WORDS = 25
#: Of so many consecutive windows of a document one at least is looked at.
APART = 13


class Lines:
    """The paragraphs (lines with ``least`` words or more) of a run of texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, least: int):
        self.breaks = np.flatnonzero(raw == 0x0A) + 1
        self.offsets, self.bounds = offsets, np.unique(np.concatenate([offsets, self.breaks, [len(raw)]]))
        owner = np.searchsorted(offsets, self.bounds[:-1], side="right") - 1
        number = np.arange(len(owner)) - np.searchsorted(self.bounds[:-1], offsets[owner])
        text = self.text = Words(raw, self.bounds)
        counts = np.diff(text.first)
        kept = self.kept = np.flatnonzero(counts >= least)
        self.owner, self.number, self.words = owner[kept], number[kept], counts[kept]
        self.start, self.end = (self.bounds[:-1] - offsets[owner])[kept], (self.bounds[1:] - offsets[owner])[kept]
        begin = text.starts[text.first[:-1][kept]]
        self.whole = xxh64(text.buffer, begin, text.ends[text.first[1:][kept] - 1] - begin)

    def shingles(self, which: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of some of the kept lines, end to end, and where each line's begin."""
        number = np.maximum(self.words[which] - words + 1, 1)
        index = np.concatenate([[0], np.cumsum(number)])
        word = np.repeat(self.text.first[:-1][self.kept[which]] - index[:-1], number) + np.arange(index[-1])
        last = word + np.repeat(np.minimum(self.words[which], words), number) - 1
        return xxh64(self.text.buffer, self.text.starts[word], self.text.ends[last] - self.text.starts[word]), index

    def of_documents(self) -> np.ndarray:
        """Bounds of each document's words."""
        return self.text.first[np.searchsorted(self.bounds, self.offsets)]


_ODD = 0x9E3779B97F4A7C15


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive ones: differences of prefix sums under powers of an odd number, modulo 2^64."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
        return mix((prefix[size:] - prefix[:-size]) * inverse[: n - size + 1], 19)


def _run_of(best: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """``best`` over each ``size`` consecutive values."""
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out, done = best(out[:-step], out[step:]), done + step
    return out


def picked_windows(text: Words, first: np.ndarray, width: int, apart: int = APART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash) of some windows of ``width`` words, chosen by their own first words; and the hashes of all words.

    ``first`` bounds each document's words.  Of ``apart`` consecutive windows
    of a document those are picked that begin with the shingle of the least
    hash.  A run of ``width + apart - 1`` words that two documents share thus
    has a window that is picked in both, wherever it begins and its lines break.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    number = np.maximum(np.diff(first) - width + 1, 0)
    total = int(number.sum())
    if not total:
        return none
    words = xxh64(text.buffer, text.starts, text.ends - text.starts)
    before = np.cumsum(number) - number
    word = np.repeat(first[:-1] - before, number) + np.arange(total)
    # documents stand ``apart`` - 1 empty places from one another
    gaps = apart - 1
    place = np.repeat(gaps * (1 + np.arange(len(number))), number) + np.arange(total)
    begun = np.full(total + gaps * (len(number) + 1), np.iinfo(np.uint64).max)
    begun[place] = _rolled(words, min(WORDS, width))[word]
    least = _run_of(np.maximum, _run_of(np.minimum, begun, apart), apart)
    at = np.flatnonzero(least[place - gaps] == begun[place])
    word = word[at]
    hashes = _rolled(words, width)[word]
    # of equal ones in a row, as in a text that repeats one word, one in each ``apart`` words is enough
    owner = np.searchsorted(first, word, side="right")
    fresh = np.ones(len(word), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    since = (word - word[fresh][np.cumsum(fresh) - 1]) // apart
    fresh[1:] |= since[1:] != since[:-1]
    return word[fresh], hashes[fresh], words


def contexts(text: Words, words: np.ndarray, first: np.ndarray, word: np.ndarray, width: int, apart: int = APART) -> list[np.ndarray]:
    """The ``apart`` - 1 words before, and behind, each window, as bytes: 16 bits of each word's hash, outwards, then its bytes with the space.

    The hash is 0, which ends what is equal, beyond the document and where a
    word and its space have over 255 bytes.
    """
    owner = np.searchsorted(first, word, side="right") - 1
    reach = np.arange(1, apart)
    sides = []
    for place, edge in ((word[:, None] - reach, text.raw_starts), (word[:, None] + (width - 1) + reach, text.raw_ends)):
        inside = (place >= first[owner][:, None]) & (place < first[owner + 1][:, None])
        place = np.clip(place, 0, len(words) - 1)
        inner = place + 1 if edge is text.raw_starts else place - 1
        size = np.abs(edge[np.clip(inner, 0, len(words) - 1)] - edge[place])
        inside &= size < 256
        hashes = np.where(inside, words[place].astype(np.uint16) | np.uint16(1), np.uint16(0))
        sides.append(np.hstack([hashes.view(np.uint8), np.where(inside, size, 0).astype(np.uint8)]))
    return sides


def extents(mine: np.ndarray, other: np.ndarray, apart: int = APART) -> tuple[np.ndarray, np.ndarray]:
    """(words, bytes) that rows of one side of ``contexts`` have in common with others, next to the window."""
    reach = apart - 1
    a, b = (np.ascontiguousarray(x[:, : 2 * reach]).view(np.uint16) for x in (mine, other))
    equal = np.logical_and.accumulate((a == b) & (a != 0), axis=1)
    return equal.sum(axis=1).astype(np.int32), (mine[:, 2 * reach :] * equal).sum(axis=1).astype(np.int32)


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(len(column), -1)


def _place_key(whole: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(whole ^ mix(doc.astype(np.int64).view(np.uint64), 11) ^ mix(number.astype(np.uint64), 13), 17)


def _row_key(row: np.ndarray, word: np.ndarray | int) -> np.ndarray:
    return mix(row.astype(np.int64).view(np.uint64) ^ mix(np.atleast_1d(np.asarray(word, np.int64)).view(np.uint64), 3), 7)


def _doc_key(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64), 29)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def _shared(windows: DataFrame) -> DataFrame:
    """(of_hash, keep_row, keep_word) of the windows (hash, doc_id, row_no, word) that two documents have: the first copy, which stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no", "word")).alias("first")
    seen = windows.groupBy(F.col("hash").alias("of_hash")).agg(first, F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    return materialize(seen.select("of_hash", F.col("first.row_no").alias("keep_row"), F.col("first.word").alias("keep_word")), "shared")


_RUN = {
    "row_no": "long", "word": "int", "last_word": "int", "hash": "long", "last_hash": "long", "least": "long", "keep_row": "long", "keep_word": "int", "keep_last_word": "int", "kept": "boolean",
}


def _runs(windows: DataFrame, shared: DataFrame) -> DataFrame:
    """Runs of the shared windows of a text whose first copies lie in one document, with their first, last and least windows; see ``_RUN``.

    Windows of a run begin at most ``APART`` words apart.
    """
    # merge joins at every size, whose hot keys can be split, and not one plan for small tables and another for large ones
    rows = windows.join(shared.hint("merge"), windows["hash"] == shared["of_hash"]).select("row_no", "word", "hash", "keep_row", "keep_word")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches):
            row, word, hashes, keep, keep_word = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            kept = (keep == row) & (keep_word == word)
            new = np.ones(len(word), bool)
            new[1:] = (np.diff(row) != 0) | (np.diff(word) > APART) | (keep[1:] != keep[:-1]) | (kept[1:] != kept[:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(word)) - 1
            runs = (row[at], word[at], word[last], hashes[at], hashes[last], np.minimum.reduceat(hashes, at), keep[at], keep_word[at], keep_word[last], kept[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in runs], list(_RUN))

    schema = ", ".join(f"{n} {t}" for n, t in _RUN.items())
    return materialize(rows.repartition("row_no").sortWithinPartitions("row_no", "word").mapInArrow(released(merge), schema), "runs")


def _ends(runs: DataFrame, source: DataFrame, least: int) -> DataFrame:
    """(row_no, word, paragraph, start, end, line, before, behind) of the windows at which runs, and their first copies, begin and end.

    Only texts that have any are read for this.  ``line`` is the hash of the
    line that a window lies within, or 0.
    """
    sides = [("row_no", "word"), ("row_no", "last_word"), ("keep_row", "keep_word"), ("keep_row", "keep_last_word")]
    asked = None
    for row, word in sides:
        part = runs.select(F.col(row).alias("row_no"), F.col(word).alias("word"))
        asked = part if asked is None else asked.unionByName(part)
    asked = materialize(asked.distinct(), "asked")

    def row_keys(batch: pa.RecordBatch) -> np.ndarray:
        """Of each place asked for, and of each text that has any."""
        row, word = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        return np.concatenate([_row_key(row, word), _row_key(row, -1)])

    cells = filter_cells(2 * asked.count(), MAX_CELLS)
    marked = source.sparkSession.sparkContext.broadcast(filter_bits(asked, cells, repeated=False, read=row_keys))
    names = ["row_no", "word", "paragraph", "start", "end", "line", "before", "behind"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, cells, _row_key(batch.column(2).to_numpy(zero_copy_only=False), -1))))
            for low, _, raw, offsets in text_slices(batch.column(1)):
                lines = Lines(raw, offsets, least)
                text, first = lines.text, lines.of_documents()
                word, _, single = picked_windows(text, first, least)
                owner = np.searchsorted(first, word, side="right") - 1
                row, place = batch.column(2).to_numpy(zero_copy_only=False)[low + owner], (word - first[owner]).astype(np.int32)
                hit = passes(bits, cells, _row_key(row, place)) if len(word) else np.zeros(0, bool)
                if not hit.any():
                    continue
                word, owner = word[hit], owner[hit]
                whole, within = np.zeros(len(lines.bounds) - 1, np.uint64), np.zeros(len(lines.bounds) - 1, bool)
                whole[lines.kept], within[lines.kept] = lines.whole, True
                a, b = (np.searchsorted(text.first, w, side="right") - 1 for w in (word, word + least - 1))
                start = text.raw_starts[word]
                number = np.searchsorted(lines.breaks, start, side="right") - np.searchsorted(lines.breaks, offsets[owner], side="right")
                places = (number, start - offsets[owner], text.raw_ends[word + least - 1] - offsets[owner])
                columns = [
                    pa.array(row[hit]),
                    pa.array(place[hit]),
                    *(pa.array(x.astype(np.int32)) for x in places),
                    pa.array(np.where(within[a] & (a == b), whole[a], np.uint64(0)).view(np.int64)),
                    *(pa.array([c.tobytes() for c in side], pa.binary()) for side in contexts(text, single, first, word, least)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = mapped(source, read, "row_no long, word int, paragraph int, start int, end int, line long, before binary, behind binary")
    # texts that are alike in id and words have the same row_no
    return materialize(found.dropDuplicates(["row_no", "word"]), "ends")


def _reached(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """``runs`` with paragraph, start, end and line, and words and bytes by which each goes on, before and behind, like the copy that stays.

    A copy that stays goes on as far as any other does with it.
    """
    out = runs
    for side, (word, wanted) in enumerate((("word", ("paragraph", "start", "line", "before")), ("last_word", ("paragraph", "end", "line", "behind")))):
        here = ends.select(F.col("row_no").alias("at_row"), F.col("word").alias("at_word"), *[F.col(c).alias(f"{c}_{side}") for c in wanted])
        out = out.join(here.hint("merge"), (out["row_no"] == here["at_row"]) & (out[word] == here["at_word"])).drop("at_row", "at_word")
    one_line = (F.col("line_0") == F.col("line_1")) & (F.col("paragraph_0") == F.col("paragraph_1")) & (F.col("line_0") != 0)
    out = out.withColumns({"line": F.when(one_line, F.col("line_0")), "paragraph": F.col("paragraph_0"), "start": F.col("start_0"), "end": F.col("end_1")})
    out = materialize(out.drop("line_0", "line_1", "paragraph_0", "paragraph_1", "start_0", "end_1"), "placed")
    kept, others = out.where("kept"), out.where("not kept")
    for side, (keep, of) in enumerate((("keep_word", "before"), ("keep_last_word", "behind"))):
        there = ends.select(F.col("row_no").alias("at_row"), F.col("word").alias("at_word"), F.col(of).alias(f"theirs_{side}"))
        others = others.join(there.hint("merge"), (others["keep_row"] == there["at_row"]) & (others[keep] == there["at_word"])).drop("at_row", "at_word")
    reach = [f"{c}_{side}" for side in range(2) for c in ("words", "bytes", "keep_bytes")]
    told = [f for f in out.schema.fields if f.name not in ("before_0", "behind_1")]
    columns = [*(f.name for f in told), *reach]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for side, of in enumerate(("before", "behind")):
                mine, theirs = (_bytes(batch.column(f"{n}_{side}")) for n in (of, "theirs"))
                found += [*extents(mine, theirs), extents(theirs, mine)[1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-6]), *map(pa.array, found)], columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told)
    others = materialize(others.mapInArrow(released(measure), kinds + "".join(f", {c} int" for c in reach)), "reached")
    for side, hashes in enumerate(("hash", "last_hash")):
        most = others.groupBy(F.col(hashes).alias("most_hash")).agg(F.max(F.struct(f"words_{side}", f"keep_bytes_{side}")).alias("most"))
        kept = kept.join(most, kept[hashes] == most["most_hash"], "left")
        kept = kept.withColumns({f"words_{side}": F.coalesce(f"most.words_{side}", F.lit(0)), f"bytes_{side}": F.coalesce(f"most.keep_bytes_{side}", F.lit(0))}).drop("most_hash", "most")
    return others.drop("keep_bytes_0", "keep_bytes_1").unionByName(kept.drop("before_0", "behind_1"))


def _passages(windows: DataFrame, shared: DataFrame, source: DataFrame, clustered: DataFrame, least: int) -> DataFrame:
    """Rows of the passages that the shared windows make up, but for those within lines of ``clustered`` (of_whole)."""
    runs = _runs(windows, shared)
    # runs of one cluster have their first, last or least window in common with one another, be it by way of others
    links = [runs.select(F.col("least").alias("src"), F.col(c).alias("dst")) for c in ("hash", "last_hash")]
    roots = components(links[0].unionByName(links[1]).distinct(), "passages")
    named = _reached(runs, _ends(runs, source, least)).join(roots, F.col("least") == roots["node"], "left").withColumn("cluster", F.coalesce("root", "least"))
    size = F.col("last_word") - F.col("word") + F.col("words_0") + F.col("words_1") + F.lit(least)
    named = named.withColumns({"words": size, "start": F.col("start") - F.col("bytes_0"), "end": F.col("end") + F.col("bytes_1")})
    ids = materialize(windows.select(F.col("row_no").alias("of_row"), F.col("doc_id").alias("id")).distinct(), "ids")
    named = named.join(ids, named["row_no"] == ids["of_row"]).drop("of_row").withColumnRenamed("id", "doc_id")
    named = named.join(ids, named["keep_row"] == ids["of_row"]).withColumnRenamed("id", "keep_id")
    named = materialize(named.select("doc_id", "paragraph", "start", "end", "words", "cluster", "line", "keep_id", "kept"), "named")
    copies = materialize(named.groupBy(F.col("cluster").alias("of_cluster")).agg(F.count("*").alias("copies")), "copies")
    named = named.join(copies, named["cluster"] == copies["of_cluster"])
    return named.join(clustered, named["line"] == clustered["of_whole"], "left_anti")


def repeated_paragraphs(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, least: int = MIN_WORDS) -> DataFrame:
    """Every paragraph that another document also has, or nearly so, and every passage that stands word by word in another document.

    Returns doc_id, paragraph (lines before it, or before a passage's first window), start and end (bytes of the
    UTF-8 text), words, cluster, copies (rows that the cluster has before any
    are left out), keep_id (the document that keeps it), kept and kind.

    ``paragraph``: lines of ``least`` words or more; A-Z count as a-z.  Equal
    ones are first made one.  MinHash bands, tuned to find 99.5 % of pairs at
    the threshold, bring candidates together; the exact Jaccard similarity of
    their sets of ``words``-word shingles decides about links, and clusters
    are the components of links.  Of a cluster the first paragraph by doc_id
    and place stays.

    ``passage``: runs of equal words, however they are broken into lines and
    whatever stands around them.  Windows of ``least`` words are picked by
    their own words, so that any run of ``least + APART - 1`` equal words has
    one in common at least, and shorter ones often.  A window's first copy by
    doc_id and place stays.  Windows next to one another whose first copies
    stand in one document make a row, which goes on, word by word, before its
    first and behind its last window as far as the copy that stays does; a
    first copy goes as far as any other does with it.  (Words are told apart
    by 15 bits there: one end in some thousands has a word too many.)  Clusters
    are components of passages whose first, last or least windows are the same.
    A passage within a line that already has a row is left out.

    Clusters within one document are left out, so that a document which only
    repeats itself has no row.  Null and empty texts have no paragraphs; rows
    that share a doc_id count as one document, and have rows for passages once
    if their texts are the same too; a null id comes last and counts for none.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bands, rows = tuned_bands(similarity)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("row_no"))
    names = ["doc_id", "whole", "paragraph", "start", "end", "words", "packed", "row_no", "places"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paragraphs with their bands, and documents with the hashes of their windows."""
        for batch in batches:
            for low, _, raw, offsets in text_slices(batch.column(1)):
                lines = Lines(raw, offsets, least)
                if len(lines.kept):
                    hashes = band_hashes(*lines.shingles(np.arange(len(lines.kept)), words), bands, rows)
                    places = (pa.array(x.astype(np.int32)) for x in (lines.number, lines.start, lines.end, lines.words))
                    packed = pa.array([h.tobytes() for h in hashes], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(low + lines.owner)), pa.array(lines.whole.view(np.int64)), *places, packed, pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.binary())], names)
                first = lines.of_documents()
                word, hashes, _ = picked_windows(lines.text, first, least)
                if len(word):
                    owner, at = np.unique(np.searchsorted(first, word, side="right") - 1, return_index=True)
                    packed = pa.array([h.tobytes() for h in np.split(hashes, at[1:])], pa.binary())
                    begins = np.repeat(first[owner], np.diff([*at, len(word)]))
                    places = pa.array([p.tobytes() for p in np.split((word - begins).astype(np.int32), at[1:])], pa.binary())
                    empty = [pa.nulls(len(owner), pa.int64()), *[pa.nulls(len(owner), pa.int32())] * 4]
                    of = pa.array(low + owner)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *empty, packed, batch.column(2).take(of), places], names)

    def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        values, row = unpacked(batch.column(1))
        at = pa.array(row)
        return values, [batch.column(0).take(at), batch.column(2).take(at), pa.array(unpacked(batch.column(3), np.int32)[0])]

    # bands and windows are the largest tables by far, and are deleted when the buckets and the shared windows are written
    with scratch() as keep:
        units = materialize(mapped(source, read, "doc_id long, whole long, paragraph int, start int, end int, words int, packed binary, row_no long, places binary"), "units")
        found = units.where("words is not null")
        packed = units.where("words is null").select("doc_id", "packed", "row_no", "places")
        number = packed.agg(F.coalesce(F.sum(F.octet_length("packed")), F.lit(0))).first()[0] // 8
        windows = keep(materialize(maybe_shared(packed, number, unpack, "hash long, doc_id long, row_no long, word int"), "windows"))
        shared = keep(_shared(windows))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "paragraph", "start"))
        unique = found.groupBy("whole").agg(F.count("*").alias("n"), first.alias("first"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
        unique = keep(materialize(unique, "unique"))
        met = keep(buckets(found.select(F.col("whole").alias("node"), F.col("packed").alias("bands")), "bands"))
        found = keep(materialize(found.drop("packed", "row_no", "places"), "found"))
    groups = groups_of(bucket_links(met), met, name="candidates")
    # of the rest only paragraphs that stand in two documents matter
    met_once = materialize(groups.select(F.col("node").alias("of_node")).distinct(), "met_once")
    among = filter_cells(met_once.count(), MAX_CELLS)
    tested = marked_rows(unique, "whole", filter_bits(met_once.select(F.col("of_node").alias("key")), among, repeated=False), among).where("tessella_maybe or least_id <> most_id").drop("tessella_maybe")
    unique = materialize(tested.join(met_once, tested["whole"] == met_once["of_node"], "left").where("of_node is not null or least_id <> most_id"), "candidates")

    # the shingles of one paragraph of each candidate, from a second reading of the documents that have any
    wanted = materialize(unique.where("of_node is not null").select("whole", "first.doc_id", "first.paragraph"), "wanted")

    def line_keys(batch: pa.RecordBatch) -> np.ndarray:
        whole, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        return _place_key(whole.view(np.uint64), _ids(batch.column(1)), number)

    cells = filter_cells(wanted.count(), MAX_CELLS)
    of_docs = filter_bits(wanted, cells, repeated=False, read=lambda batch: _doc_key(_ids(batch.column(1))))
    marked = spark.sparkContext.broadcast((filter_bits(wanted, cells, repeated=False, read=line_keys), of_docs))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lines, of_docs = marked.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(of_docs, cells, _doc_key(_ids(batch.column(0))))))
            ids = _ids(batch.column(0))
            for low, _, raw, offsets in text_slices(batch.column(1)):
                lines = Lines(raw, offsets, least)
                hit = np.flatnonzero(passes(of_lines, cells, _place_key(lines.whole, ids[low + lines.owner], lines.number))) if len(lines.kept) else np.zeros(0, int)
                if len(hit):
                    hashes, index = lines.shingles(hit, words)
                    items = pa.array([np.unique(hashes[a:b]).view(np.int64) for a, b in zip(index, index[1:])], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(lines.whole[hit].view(np.int64)), items], ["read_whole", "items"])

    with scratch() as keep:
        reread = mapped(source.select("doc_id", "text"), again, "read_whole long, items array<long>")
        shingled = materialize(reread.groupBy("read_whole").agg(F.first("items").alias("items")), "shingled")
        members = groups.join(shingled, groups["node"] == shingled["read_whole"]).select("grp", "node", "items")
        linked = keep(materialize(components(links_within(members, similarity), "links"), "linked"))

    rooted = unique.join(linked, unique["whole"] == linked["node"], "left").select("whole", "n", "first", "least_id", "most_id", F.coalesce("root", "whole").alias("root"))
    clusters = rooted.groupBy("root").agg(F.sum("n").alias("copies"), F.min("first").alias("keep"), F.min("least_id").alias("low"), F.max("most_id").alias("high")).where("low <> high")
    named = rooted.select("whole", "root").join(clusters, "root").select(F.col("whole").alias("of_whole"), F.col("root").alias("cluster"), "copies", "keep")
    named = materialize(named, "clusters")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("paragraph") == F.col("keep.paragraph")) & (F.col("start") == F.col("keep.start"))
    columns = ["doc_id", "paragraph", "start", "end", "words", "cluster", "copies", "keep_id", "kept", "kind"]
    least_cells = filter_cells(named.count(), MAX_CELLS)
    in_clusters = marked_rows(found, "whole", filter_bits(named.select(F.col("of_whole").alias("key")), least_cells, repeated=False), least_cells).where("tessella_maybe").drop("tessella_maybe")
    whole_lines = in_clusters.join(named, in_clusters["whole"] == named["of_whole"]).withColumns({"keep_id": F.col("keep.doc_id"), "kept": kept, "kind": F.lit("paragraph")})
    passages = _passages(windows, shared, source, named.select("of_whole"), least).withColumn("kind", F.lit("passage"))
    return whole_lines.select(*columns).unionByName(passages.select(*columns))


def op7_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(documents(spark, sf_dir))


SQL: str | None = None
