"""Repeated paragraphs and links by Jaccard similarity against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessella import session
from tessella.llm import jaccard, paragraphs
from tests.llm.helpers import DOC_SCHEMA, frame, rows
from tests.llm.test_text_ops import shingle_bytes


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, near = line(60), line(80).split()
    data = []
    for i in range(40):
        lines = [line(rng.choice([3, 30, 50])) for _ in range(4)]
        if i % 4 == 0:
            lines.insert(rng.randrange(4), shared if i % 8 else shared.upper().replace(" ", "  "))
        if i % 5 == 0:
            other = list(near)
            other[rng.randrange(80)] = word()
            lines.insert(0, " ".join(other))
        if i == 7:
            lines += [lines[-1]] * 2 + ["only here " * 20] * 2
        data.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"]), "en", "s", 0))
    return data


def plain(data, similarity=0.8, least=25):
    items = []
    for i, text, *_ in data:
        at = 0
        for number, line in enumerate((text or "").split("\n")):
            size = len(line.encode()) + 1
            parts = shingle_bytes(line, 5)
            if len(shingle_bytes(line, 1)) >= least:
                items.append((i, number, at, min(at + size, len(text.encode())), set(parts)))
            at += size
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            x, y = items[a][4], items[b][4]
            if len(x & y) >= similarity * len(x | y):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(items)):
        groups[find(k)].append(items[k])
    out = set()
    for members in groups.values():
        if len({m[0] for m in members if m[0] is not None}) > 1:
            first = min(members, key=lambda m: (m[0] is None, m[0] or 0, m[1]))
            out |= {(str(i), n, s, e, len(members), str(first[0]), (i, n) == first[:2]) for i, n, s, e, _ in members}
    return out


def test_tuned_bands():
    bands, width = jaccard.tuned_bands(0.8)
    assert 1 - (1 - 0.8**width) ** bands >= 0.995 and 1 - (1 - 0.4**width) ** bands <= 0.25
    assert (bands, width) == (11, 4)


def test_repeated_paragraphs(spark):
    data = planted()
    long = [(9100 + r[0], r[1], *r[2:]) for r in rows(2) if r[0] == 6000]
    data += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, data[0][1], "en", "s", 0), *long]
    got = [r for r in paragraphs.repeated_paragraphs(frame(spark, data)).collect() if r.kind == "paragraph"]
    assert {(str(r.doc_id), r.paragraph, r.start, r.end, r.copies, str(r.keep_id), r.kept) for r in got} == plain(data)
    assert 7 not in {r.doc_id for r in got}
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_passages_whatever_their_line_breaks(spark):
    rng = random.Random(3)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, inner = some(90), some(paragraphs.MIN_WORDS + paragraphs.APART - 1)
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    data = [
        (1, wrapped(passage, 9), "en", "s", 0),
        (2, "\n" + wrapped(some(5) + passage, 14).upper(), "en", "s", 0),
        (3, " ".join(some(200) + passage + some(200)), "en", "s", 0),
        (4, " ".join(some(300) + inner + some(100)), "en", "s", 0),
        (5, " ".join(some(40) + inner + some(150)), "en", "s", 0),
        (6, wrapped(some(300), 10), "en", "s", 0),
        (7, "\n".join([wrapped(some(60), 10)] * 2), "en", "s", 0),
        (None, wrapped(some(50) + inner, 12), "en", "s", 0),
    ]
    got = paragraphs.repeated_paragraphs(frame(spark, data)).collect()
    text = {d[0]: d[1].encode() for d in data}
    clusters = defaultdict(list)
    for r in got:
        assert r.kind == "passage" and 0 <= r.paragraph - text[r.doc_id][: r.start].count(b"\n") <= 2
        clusters[r.cluster].append((r, text[r.doc_id][r.start : r.end].decode().lower().split()))
        assert len(clusters[r.cluster][-1][1]) == r.words
    # one row a passage, from its first word to its last
    assert {tuple(sorted(r.doc_id or 0 for r, _ in m)) for m in clusters.values()} == {(0, 4, 5), (1, 2, 3)}
    for members in clusters.values():
        assert all(words in (passage, inner) and words == members[0][1] for _, words in members)
        assert all(r.copies == 3 for r, _ in members)
        least = min(r.doc_id for r, _ in members if r.doc_id is not None)
        assert {(r.doc_id, r.keep_id, r.kept) for r, _ in members} == {(r.doc_id, least, r.doc_id == least) for r, _ in members}


def runs_of_equal_words(data, least):
    """For each row which of its words lie in a run of ``least`` words that another document has, by all windows."""
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for _, t, *_ in data]
    holders = defaultdict(set)
    for (i, *_), words in zip(data, texts):
        for k in range(len(words) - least + 1):
            holders[tuple(words[k : k + least])].add(i)
    shared = {w for w, ids in holders.items() if len(ids - {None}) > 1}
    out = []
    for words in texts:
        hit = set()
        for k in range(len(words) - least + 1):
            if tuple(words[k : k + least]) in shared:
                hit |= set(range(k, k + least))
        out.append(hit)
    return out


def test_passages_cover_all_long_equal_runs(spark):
    rng = random.Random(11)
    some = lambda n: [rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n)]
    pool = [some(rng.randrange(10, 120)) for _ in range(12)]
    data = []
    for i in range(60):
        words = [w for _ in range(rng.randrange(4)) for w in some(rng.randrange(60)) + rng.choice(pool)] + some(30)
        data.append((i, "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in words), "en", "s", 0))
    data += [(100, data[3][1], "en", "s", 0), (101, data[3][1], "en", "s", 0), (3, data[5][1], "en", "s", 0), (None, data[9][1], "en", "s", 0)]
    least = paragraphs.MIN_WORDS
    got = paragraphs.repeated_paragraphs(frame(spark, data)).collect()
    # rows that share an id are told by their text
    want_25, want_37 = runs_of_equal_words(data, least), runs_of_equal_words(data, least + paragraphs.APART - 1)
    covered = total = 0
    for (i, text, *_), must, may in zip(data, want_37, want_25):
        ends = [m.span() for m in re.finditer(r"\S+", text)]
        in_rows = {k for k, (a, b) in enumerate(ends) for r in got if r.doc_id == i and r.start <= a and b <= r.end}
        if i != 3:
            # a row goes as far as the copy that stays, so that what is equal to another copy only may lack up to APART - 1 words at either end
            inner = {k for k in must if all(n in must for n in range(k - paragraphs.APART + 1, k + paragraphs.APART))}
            assert inner <= in_rows <= may
            covered, total = covered + len(must & in_rows), total + len(must)
    assert covered > 0.99 * total > 1000


@pytest.mark.parametrize("part", [1000, 5])
def test_links_within(spark, part):
    rng = np.random.default_rng(2)
    bases = [rng.integers(0, 10**12, 60) for _ in range(4)]
    members, sets = [], {}
    for node in range(60):
        items = np.unique(np.concatenate([bases[node % 4][rng.random(60) < 0.95], rng.integers(0, 10**12, 1)]))
        sets[node] = set(items.tolist())
        members.append((node % 2, node, items.tolist()))
    members += [(5, 100, []), (5, 101, []), (6, 102, [1])]
    sets |= {100: set(), 101: set(), 102: {1}}
    grp = {m[1]: m[0] for m in members}
    got = [(r.src, r.dst) for r in jaccard.links_within(spark.createDataFrame(members, "grp long, node long, items array<long>"), 0.8, part).collect()]
    similar = lambda a, b: grp[a] == grp[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(similar(a, b) for a, b in got)

    def closed(links):
        root = {n: n for n in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        least = defaultdict(lambda: 10**9)
        for n in sets:
            least[find(n)] = min(least[find(n)], n)
        return {n: least[find(n)] for n in sets}

    assert closed(got) == closed([(a, b) for a in sets for b in sets if a < b and similar(a, b)])


def test_large_tables_are_deleted_on_the_way(spark):
    """Bands, windows' texts and shingles are gone when the operator returns, and its rows can be read none the less."""
    line = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, line, "en", "s", 0), (2, line + " more", "en", "s", 0), (3, "short", "en", "s", 0)])
    before = len(session._written)
    found = paragraphs.repeated_paragraphs(docs)
    names = {path.rsplit("tessella-", 1)[1].rsplit("-", 1)[0] for _, path in session._written[before:]}
    assert names >= {"windows", "shared", "found", "linked"} and not names & {"units", "shingled", "members"}
    assert sorted({r.doc_id for r in found.collect()}) == [1, 2]
