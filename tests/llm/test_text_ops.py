"""Exact dedup, SimHash and packing against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessella.llm import exact_dedup as dedup
from tessella.llm import graph, packing, simhash
from tessella.llm.graph import components
from tessella.llm.textkernel import Words, text_slices, xxh64
from tests.llm.helpers import DOC_SCHEMA, frame, rows


def shingle_bytes(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def plain_fingerprint(text, size):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingle_bytes(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {p: find(p) for p in keys}


def test_xxh64_and_words():
    texts = [r[1] for r in rows(3)] + ["a" * 70_000 + " b c d", "", None]
    column = pa.array(texts, pa.string())
    for size in (1, 3, 5):
        got = []
        for low, high, raw, offsets in text_slices(column, 3000):
            words = Words(raw, offsets)
            starts, lengths, index = words.shingles(size)
            h = xxh64(words.buffer, starts, lengths)
            got += [h[index[i] : index[i + 1]].tolist() for i in range(high - low)]
        assert got == [[xxhash.xxh64_intdigest(s, 42) for s in shingle_bytes(t, size)] for t in texts]


def test_fingerprints_and_groups(spark):
    data = rows(5)
    base = " ".join(f"w{i}" for i in range(400))
    data += [(9000 + i, base + f" tail{i}", "en", "s1", 1) for i in range(12)]
    got = simhash.near_groups(frame(spark, data)).collect()
    assert len(got) == len(data)
    prints = {t: plain_fingerprint(t, 3) for _, t, *_ in data}
    root = plain_components(set(prints.values()), 2)
    least = defaultdict(lambda: 1 << 60)
    for i, t, *_ in data:
        if i is not None:
            least[root[prints[t]]] = min(least[root[prints[t]]], i)
    want = sorted((str(i), prints[t], str(least.get(root[prints[t]]))) for i, t, *_ in data)
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want


def mutated(seed, n):
    """Random fingerprints, many with others two bits or three away, and a dense cluster."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    flip = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, len(x)), dtype=np.uint64))
    cluster = flip(np.full(n // 2, base[0]), 3)
    return np.unique(np.concatenate([base, flip(base[::2], 2), flip(base[::3], 3), cluster]))


def test_tree_meets_every_pair_and_prunes():
    fp = mutated(0, 3000)
    tree = simhash.tree_of(np.sort(fp[::5]), 6, 2)
    row, shard = tree.shards(fp, 2)
    assert set(row.tolist()) == set(range(len(fp))) and shard.min() >= 0 and shard.max() < 64
    assert len(row) < 4 * len(fp) and np.bincount(shard).max() < len(row) / 5
    at = [set() for _ in fp]
    for r, k in zip(row.tolist(), shard.tolist()):
        at[r].add(k)
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2, 1))
    assert len(a) > 1000 and all(at[x] & at[y] for x, y in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("leaf", [8, 192])
def test_shard_links(leaf):
    fp = mutated(1, 400)
    a, b = simhash.shard_links(fp, 2, leaf)
    assert (np.bitwise_count(fp[a] ^ fp[b]) <= 2).all() and len(a) < 8 * len(fp)
    _, root = graph.least_reached(np.concatenate([a, np.arange(len(fp))]), np.concatenate([b, np.arange(len(fp))]))
    want = plain_components({int(x) for x in fp}, 2)
    assert len(set(root.tolist())) == len(set(want.values()))
    for x, y in zip(a.tolist(), b.tolist()):
        assert want[int(fp[x])] == want[int(fp[y])]


def test_near_links_over_many_shards(spark):
    fp = mutated(2, 600)
    table = dedup.materialize(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), "fp")
    links = simhash.near_links(table, 2, shard=32).collect()
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = plain_components({int(x) for x in fp}, 2)
    groups = defaultdict(set)
    for x in fp.tolist():
        groups[want[x]].add(int(np.uint64(x).view(np.int64)))
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_components_long_chain(spark):
    edges = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)] + [(500, 501), (501, 501), (502, 502)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_rising_chain_in_few_rounds(spark, monkeypatch):
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(name) or plain(df, name))
    chain = spark.range(2000).selectExpr("id AS src", "id + 1 AS dst")
    # many partitions, so that no task sees more of the chain than some links
    got = components(chain.repartition(16)).groupBy("root").count().collect()
    assert [(r.root, r["count"]) for r in got] == [(0, 2001)]
    assert len(written) < 60
    one_by_one = graph.least_reached(np.arange(1, 500), np.arange(499))
    assert (one_by_one[1] == 0).all()


@pytest.mark.parametrize("cells", [1 << 26, 256])
def test_exact_dedup(spark, cells):
    data = rows(7)
    got = dedup.exact_dedup(frame(spark, data), max_cells=cells).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in data]
    groups = defaultdict(list)
    for (i, *_), t in zip(data, norm):
        groups[t].append(i)
    want = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(str(i), str(ids[0]), len(ids), k == 0, sha) for k, i in enumerate(ids)]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)
    assert dedup.drop_copies(frame(spark, data), cells).count() == len(groups)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert dedup.exact_dedup(empty).count() == simhash.near_groups(empty).count() == packing.pack(empty).count() == 0


def test_filters_by_range_pass_few_unique_rows(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(if(id < 1000, id % 100, id)) AS key", "id")
    assert len(dedup.ranges_of(20_000, 1 << 14)) == 15
    for cells in (1 << 26, 1 << 14):
        maybe = [r.id for r in dedup.maybe_repeated(dedup.materialize(rows, "rows"), "key", cells).collect()]
        assert len(maybe) == len(set(maybe)) and set(range(1000)) <= set(maybe)
        assert len(maybe) < 1000 + 0.04 * 19_000


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    data = [r for r in rows(9) if r[0] != 5000] + [(7000, "odd <|endoftext|> \x1c x y Σίσυφοσ É", "en", "s1", 1)]
    pieces = packing.pack(frame(spark, data)).collect()
    tokenizer = Tokenizer.from_file(packing.public_file(packing.TOKENIZER))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == len(data)
    for i, text, *_ in data:
        parts = sorted(by_doc[i], key=lambda p: p.start)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == ids
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert {p.doc_tokens for p in parts} == {len(ids)}
    used = []
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        used.append(sum(p.length for p in parts))
    assert max(used) <= 2048
    assert sum(used) > 0.9 * 2048 * (len(used) - 4)


def test_cuts_cover_and_fit():
    for tokens in range(1, 5000, 7):
        pieces = packing.cuts(tokens)
        assert sum(n for n, _ in pieces) == tokens
        assert all(2048 // (j + 1) < n <= 2048 // j for n, j in pieces)


def test_ids_crc(spark):
    row = packing.pack(frame(spark, [(1, "the run", "en", "s", 7)])).selectExpr("crc32(ids) c", "ids").first()
    assert row.c == zlib.crc32(row.ids)


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert packing.parts_agree(packing.public_file(packing.TOKENIZER))
    other = Tokenizer(models.WordLevel({"<unk>": 0, "the": 5, "run": 7, ",": 9}, unk_token="<unk>"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    path = str(tmp_path / "other.json")
    assert not packing.parts_agree(path)
    row = packing.pack(frame(spark, [(1, "the run, THE", "en", "s", 7)]), tokenizer=path).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [5, 7, 9, 0, 1]
