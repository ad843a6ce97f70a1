"""Mixing, sharding and top-k search against brute force."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, sharding, topk
from tests.llm.helpers import DOC_SCHEMA, frame, rows


def plain_targets(sizes, share=1.5, most=2.0):
    """Shares by weight; whatever is above its cap stops there, and the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_targets_and_budgets(spark):
    data = rows(2, 300)
    got = mixing.mix(frame(spark, data)).collect()
    assert len(got) == len(data)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.size * r.repeats and 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(frame(spark, data, clash=False).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_prefers_quality_and_levels_agree(spark):
    data = [(i, "w " * 10, "s", "a", 1) for i in range(4000)]
    docs = frame(spark, data)
    quality = F.when(docs["doc_id"] % 2 == 0, 1.0).otherwise(0.1)
    got = mixing.mix(docs, quality=quality, share=0.25).collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    odd = sum(r.taken for r in got if r.doc_id % 2)
    assert even > 4 * odd and even + odd == 10_000


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None, None, None), (2, " ", "en", "s", 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_mixed_rows_are_those_of_mix(spark):
    data = rows(4) + [(None, f"no id {i}", "en", "s1", 1) for i in range(9)] + [(7, f"the same id {i}", "en", "s2", 1) for i in range(9)] + [(8000, "alike in all " * 3, "en", "s1", 1)] * 25
    labels = spark.createDataFrame([(i * 7, i % 3 > 0, None) for i in range(60)] + [(None, True, 1), (7, None, 0)], "doc_id long, quality boolean, size int").selectExpr("doc_id", "cast(quality as int) quality", "size")
    for share in (1.5, 0.6):
        docs = frame(spark, data)
        text = {}
        plan = mixing.mix(docs, labels=labels, share=share).collect()
        got = mixing.mixed(docs, labels=labels, share=share)
        assert got.columns == docs.columns
        counts, words = defaultdict(int), defaultdict(int)
        for r in plan:
            counts[r.source, r.doc_id] += r.repeats
            words[r.source] += r.taken
        for r in got.collect():
            counts[r.source, r.doc_id] -= 1
            words[r.source] -= len((r.text or "").split())
        assert not any(counts.values()) and not any(words.values()), text


def test_quality_is_learned(spark):
    data = [(i, ("good words here " if i % 2 else "b@d w%%ds #### ") * 5, "en", "s", 1) for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 3000, 3)], "doc_id long, quality int")
    docs = frame(spark, data)
    cells = docs.select("doc_id", mixing.quality_cell(docs["text"]).alias("cell"))
    table, default = mixing.cell_weights(cells, labels)
    weight = sorted(r.weight for r in table.collect())
    assert len(weight) == 2 and weight[0] < 0.01 and weight[1] > 0.99 and abs(default - 0.5) < 0.01
    got = mixing.mix(docs, labels=labels, share=0.4).collect()
    assert sum(r.repeats for r in got if r.doc_id % 2) > 10 * sum(r.repeats for r in got if r.doc_id % 2 == 0)


def test_hilbert_visits_neighbours():
    for bits, dims in ((3, 2), (2, 3), (4, 2), (2, 4)):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert(cells, bits)
        order = cells[np.argsort(index)]
        assert sorted(index.tolist()) == list(range(n**dims))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_strings_count_whole(spark):
    names = [None, "", "https://a", "https://b", "https://ba", "z", "é"]
    data = [(i, "x", "en", names[i % 7], 1) for i in range(70)]
    got = sharding.value_ranks(spark.createDataFrame(data, DOC_SCHEMA).select("doc_id", "source"), "source").collect()
    assert {(names[r.doc_id % 7], r.source) for r in got} == {(n, k - 1 if k else None) for k, n in enumerate(names)} and len(got) == 70
    # one cell a value, so that runs of the curve part the sources, and null lies lowest
    docs = frame(spark, data)
    curves = {}
    for r in sharding.shard(docs, {"source": docs["source"]}).collect():
        assert curves.setdefault(names[r.doc_id % 7], r.curve) == r.curve
    assert [curves[n] for n in names] == sorted(set(curves.values()))


def test_shards(spark):
    data = rows(6, 200)
    docs = frame(spark, data)
    dims = {"source": docs["source"], "length": F.octet_length(docs["text"])}
    got = sharding.shard(docs, dims).collect()
    body = lambda r: (r[1] or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len(body(r)) + 1, zlib.crc32(body(r))) for r in data)
    # within a cell of the curve rows go by text, then id
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.text_crc32, r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.curve))
    assert sorted(slots) == list(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    last = -1
    for s in sorted(slots):
        run = sorted(slots[s])
        assert [x for x, _ in run] == list(range(len(run)))
        assert [c for _, c in run] == sorted(c for _, c in run) and run[0][1] >= last
        last = run[-1][1]
    few = sharding.shard(frame(spark, data[:3]), {"length": F.lit(1)}).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert sharding.shard(empty, {"id": empty["doc_id"]}).count() == 0


def plain_top_k(vectors, k):
    out = []
    for n, (q, v) in enumerate(vectors):
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(vectors) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("group", [topk.GROUP, 9])
def test_top_k(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x[100:260] = x[100]
    data = [(i - 40, x[i].tolist()) for i in range(400)]
    bad = [(1001, None), (1020, [1.0, None] * 3), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [1.0] * 6)]
    # rows that share an id, queries among them, count each
    data += data[:5] + data[40:42] + [(300, data[8][1])]
    vectors = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in data]
    frame_ = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("low", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_k(frame_, group=group).collect())
    assert got == plain_top_k(vectors, 20)


def test_top_k_few_and_wide(spark):
    schema = "vec_id long, embedding array<double>"
    data = [(0, [1000.0, 2.0]), (1, [-3000.0]), (2, []), (20, [5.0, 7.0])]
    vectors = [(i, ([math.floor(64 * c) for c in v] + [0, 0])[:2]) for i, v in data]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(data, schema)).collect())
    assert got == plain_top_k(vectors, 20)
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame(data[:1], schema)).count() == 0
