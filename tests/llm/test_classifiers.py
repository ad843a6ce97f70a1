"""Language identification and toxicity: kernels against plain code, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import language, toxicity
from tests.llm.helpers import DOC_SCHEMA, frame, rows

LANGS = {"en": "the and ing ly of to", "de": "der und ung lich von sch", "fr": "les eau oi et de que", "es": "los ción que el ado ñas"}


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        parts = LANGS[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 80))]
        out.append((i, " ".join(words), lang, "s", 0))
    return out


def plain_presence(text):
    body = bytes(language._LETTERS[b] for b in text.encode())
    bins = set()
    for k in range(1, 5):
        for i in range(len(body) - k + 1):
            code = int.from_bytes(body[i : i + k], "big")
            bins.add(((code * 2654435761 + (k * 0x9E3779B1 & 0xFFFFFFFF)) * 2246822519 & 0xFFFFFFFF) >> (32 - language.BIN_BITS))
    return bins


def test_presence_per_text():
    texts = ["", "a", "Ab c!", "déjà vu", "", "x" * 5, "été", "abc def ghi"]
    hit = language.spectrum(texts)
    bins = [plain_presence(t) for t in texts]
    assert [set(np.flatnonzero(h).tolist()) for h in hit] == bins
    landmarks = language.Landmarks(texts[1:4])
    want = [[len(x & y) / max(1, len(x) * len(y)) ** 0.5 for y in bins[1:4]] for x in bins]
    assert np.allclose(landmarks.of_column(pa.array(texts)), want, atol=1e-6)
    assert language.lettered(pa.array(["½ 3 _", "é", None, "", "x", "12²"])).tolist() == [False, True, False, False, True, False]


def test_language_on_held_out_rows(spark):
    data = corpus() + [(None if r[0] is None else r[0] + 10_000, *r[1:]) for r in rows(3)]
    docs = frame(spark, data)
    # rows outside the learning fold have false languages, which must not matter
    wrong = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else la, s, n) for i, t, la, s, n in data]
    model = language.learn(frame(spark, [r for r in wrong if r[0] is None or r[0] < 240]))
    assert "xx" not in model.languages
    got = language.identify(docs, model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    truth = {i: la for i, _, la, *_ in corpus()}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    text = {i: t for i, t, *_ in corpus()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if text.get(r.doc_id)]) > 0.9
    nothing = language.identify(frame(spark, [(1, None, "en", "s", 0), (2, "12 !", "en", "s", 0), (3, "", None, None, 0)]), model).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_without_labels(spark):
    docs = frame(spark, [(1, "the and", None, "s", 0)])
    assert language.learn(docs) is None
    assert [r.lang_pred for r in language.identify(docs, None).collect()] == ["und"]
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert language.identify(empty, language.learn(empty)).count() == 0


def plain_counts(text, stems):
    low, found = text.lower(), {}
    for k, stem in enumerate(stems):
        n = sum(1 for i in range(len(low)) if low.startswith(stem, i) and not (i and low[i - 1].isalpha()))
        if n:
            found[k] = n
    return found


def test_stems_counted_in_batches():
    stems = sorted({*toxicity.LEXICON, "zugrub", "été_", "idio"})
    texts = ["", "Idiot", "an IDIOT, idiotic «idiot» bidiot", None, "scheiße Scheiß", "é" * 3 + "idiot", "idio" + "t scum" * 50_000, "sc", "um scu"] * 3
    finder = toxicity.Finder(stems)
    rows_, voters, rate = toxicity.features(pa.array(texts), finder)
    got = {}
    for r, v in zip(rows_.tolist(), voters.tolist()):
        if v < 3 * len(stems):
            got.setdefault(r, {}).setdefault(v // 3, set()).add(v % 3)
    want = {i: {k: {j for j in range(3) if n > j} for k, n in plain_counts(t or "", stems).items()} for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert rate.max() <= 10 and rate[0] == rate[3] == 0


def test_prior_of_the_table_not_of_the_sample():
    data, labels = toxic_corpus(600, 5)
    text, toxic = [d[1] for d in data], [t for *_, t in labels]
    rare = toxicity.fit(text, toxic, (sum(1 - t for t in toxic) * 50, sum(toxic)))
    even = toxicity.fit(text, toxic)
    plain = pa.array(["ta ro mi"])
    score = lambda m: toxicity.scores(plain, m, toxicity.Finder(m.stems))[0]
    assert score(rare) < score(even) < 0.2


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("ta ro mi su len kor".split()) for _ in range(rng.randint(1, 3))) for _ in range(60)]
        bad = rng.random() < 0.2
        for _ in range(4 if bad else 0):
            words[rng.randrange(60)] = "zugrub" + rng.choice(["ta", "en", "s", "mi"])
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_toxicity_learns_stems(spark):
    data, labels = toxic_corpus()
    shown = [(i, q, t) if zlib.crc32(str(i).encode()) % 5 else (i, q, 1 - t) for i, q, t in labels]
    marks = spark.createDataFrame([*shown, (None, 1, 1), (5, 1, None), *shown[:5]], "doc_id long, quality int, toxic int")
    docs = frame(spark, data + [(9001, "you stupid idiot, worthless scum", "en", "s", 0), (9002, None, None, None, 0), (9002, "", None, None, 0)])
    model = toxicity.learn(docs, marks)
    assert any(s.startswith("zugr") for s in model.stems)
    got = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert got[9001] >= 0.5 and got[9002] < 0.5
    assert all(0 <= x <= 1 for x in got.values())


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "stupid idiot scum", "en", "s", 0), (2, "a calm day", "en", "s", 0)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, toxicity.learn(docs, none)).collect()}
    assert got[1] >= 0.5 > got[2]
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert toxicity.score_texts(empty, toxicity.fit([], [])).count() == toxicity.drop_toxic(empty, toxicity.learn(empty, none)).count() == 0


def test_drop_toxic_on_awkward_rows(spark):
    data = rows(8) + [(7000, "stupid idiot scum, worthless " * 4000, "en", "s", 0)] * 2 + [(None, "stupid idiot scum worthless", "en", "s", 0)]
    docs = frame(spark, data)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    left = toxicity.drop_toxic(docs, toxicity.learn(docs, none))
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows(8))


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(3000) < hit, rng.random(3000) < false)
    a, b, c = vote(0.8, 0.1), vote(0.7, 0.1), vote(0.9, 0.2)
    x = np.stack([a, b, c, c, c], axis=1)
    marks = np.where(np.arange(3000) < 300, y, np.nan)
    post, rates, weight, rater = toxicity.label_model(x, 0.3, marks, np.where(np.isnan(marks), 0.3, marks))
    assert rater[0] < 0.1 and rater[1] > 0.9
    assert weight[2] < 0.5 < weight[0]
    assert np.mean((post > 0.5) == y) > 0.85
    assert (rates[1] > rates[0]).all()
