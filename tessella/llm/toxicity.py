"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_texts, documents, fold_of
from tessella.llm.textkernel import mapped, text_slices

#: Labelled texts of each class to learn from, and texts without a label, at most.
TRAIN_EACH = 1500
UNLABELLED = 1500
#: What a text without a label weighs in the classifier, where there are labels.
UNLABELLED_WEIGHT = 0.1
#: Stems that the labels add to the lexicon, at most, and their lengths in letters.
LEARNED_STEMS = 160
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Taken for the share of wrong labels, with the weight of so many labels, before any is seen; and the toxic share where there are no labels.
LABEL_ERROR, LABEL_TRUST = 0.02, 50.0
PRIOR = 0.05
MIN_DOCS, MIN_LIFT, MIN_EVIDENCE = 3, 8.0, 12.0

# Stems of common insults.
LEXICON = (
    "abschaum asshole bastard bitch connard crétin disgust dumb dummkopf estúpid fuck garbage idiot imbécil imbécile "
    "loser maldit merde mierda moron nazi pathetic retard salaud scheiß schlampe scum shit slut stupid subhuman trash vermin whore worthless"
).split()

_WORD = re.compile(r"[^\W\d_]+")
# Pattern voters.
PATTERNS = {
    "masked": r"(?i)\b[a-z][*@#$]{2,}[a-z]+\b",
    "attack": r"(?i)\b(?:you are|you're|du bist|tu es|eres) (?:a |an |ein |eine |un |une |una )?\w+",
    "threat": r"(?i)\b(?:kill|hate|hurt|destroy) (?:you|them|yourself)\b|\bgo to hell\b|\bshut up\b",
    "shouting": r"(?:\b[A-Z]{4,}\b[ ,!]*){4,}",
}


#: A stem has a voter for each of these numbers of words that it begins.
LEVELS = (1, 2, 3)


@dataclass
class Model:
    """Logistic regression over the voters' votes and, last, the stems' words in a hundred."""

    stems: list[str]
    weights: np.ndarray
    bias: float


def letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters: those of A-Z and a-z, and all beyond ASCII but for signs of Latin-1 and general punctuation."""
    out = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A) | (raw >= 0x80)
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE2))
    for at in (lead[raw[lead] == 0xC2], lead[(raw[lead] == 0xE2) & (raw[np.minimum(lead + 1, len(raw) - 1)] == 0x80)]):
        for k in range(2 if len(at) and raw[at[0]] == 0xC2 else 3):
            out[np.minimum(at + k, len(raw) - 1)] = False
    return out


class Finder:
    """How many words each of some stems, of four bytes or more, begins in whole batches of texts in lower case."""

    def __init__(self, stems: list[str]):
        self.stems = stems
        self.by_key: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, stem in enumerate(stems):
            raw = np.frombuffer(stem.encode(), np.uint8)
            self.by_key.setdefault(int(raw[:4].view("<u4")[0]), []).append((k, raw))
        self.keys = np.array(sorted(self.by_key), np.uint32)

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, stem, words) for each stem that a text has."""
        none = np.zeros(0, np.int64)
        if len(raw) < 4 or not len(self.keys):
            return none, none, none
        letter = letters(raw)
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        begin[edges] = letter[edges]
        at = np.flatnonzero(begin[: len(raw) - 3])
        lanes = np.ndarray((len(raw) - 3,), "<u4", raw.tobytes(), strides=(1,))[at]
        place = np.minimum(np.searchsorted(self.keys, lanes), len(self.keys) - 1)
        hit = self.keys[place] == lanes
        at, place = at[hit], place[hit]
        text = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(place, kind="stable")
        at, text, place = at[order], text[order], place[order]
        found = []
        for key, low, high in zip(self.keys.tolist(), np.searchsorted(place, np.arange(len(self.keys))), np.searchsorted(place, np.arange(len(self.keys)), side="right")):
            for k, stem in self.by_key[key] if high > low else ():
                fits = at[low:high] + len(stem) <= offsets[text[low:high] + 1]
                spot, owner = at[low:high][fits], text[low:high][fits]
                for j in range(4, len(stem)):
                    same = raw[spot + j] == stem[j]
                    spot, owner = spot[same], owner[same]
                if len(owner):
                    owner, n = np.unique(owner, return_counts=True)
                    found.append((owner, np.full(len(owner), k), n))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)


def features(texts: pa.Array, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, voter) of the voters that fire, patterns behind stems at their levels; and each text's stems' words in a hundred, ten at most."""
    rows, voters, rate = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(texts))
    texts = texts.cast(pa.large_string())
    lower = pa.compute.utf8_lower(texts)
    for low, high, raw, offsets in text_slices(lower):
        text, stem, n = finder.counts(raw, offsets)
        for j, level in enumerate(LEVELS):
            rows.append(low + text[n >= level])
            voters.append(len(LEVELS) * stem[n >= level] + j)
        spaces = np.concatenate([[0], np.cumsum(raw == 0x20)])
        rate[low:high] = 100 * np.bincount(text, n, high - low) / (1 + spaces[offsets[1:]] - spaces[offsets[:-1]])
    for k, pattern in enumerate(PATTERNS.values()):
        hit = np.flatnonzero(pa.compute.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False))
        rows.append(hit)
        voters.append(np.full(len(hit), len(LEVELS) * len(finder.stems) + k))
    return np.concatenate(rows), np.concatenate(voters), np.minimum(rate, 10.0)


def learn_stems(texts: list[str], toxic: list[int], most: int = LEARNED_STEMS) -> list[str]:
    """Beginnings of words that tell toxic texts from others: a greedy cover of the toxic ones.

    A stem counts at a level, the number of words that it begins.  It needs
    ``MIN_DOCS`` toxic texts, ``MIN_LIFT`` times the share among others, and
    ``MIN_EVIDENCE`` of log-likelihood ratio.
    """
    def counted(text: str | None, among: set | None = None) -> Iterator[tuple[str, int]]:
        starts = Counter(w[:n] for w in _WORD.findall((text or "").lower()) for n in STEM_LENGTHS if len(w) >= n)
        for stem, c in starts.items():
            if among is None or stem in among:
                for level in LEVELS[: np.searchsorted(LEVELS, c, side="right")]:
                    yield stem, level

    # stems of toxic texts first, then what the other texts have of those
    ones = {level: Counter() for level in LEVELS}
    for text, y in zip(texts, toxic):
        if y:
            for stem, level in counted(text):
                ones[level][stem] += 1
    ones = {(s, level): n for level, c in ones.items() for s, n in c.items() if n >= MIN_DOCS}
    zeros, among = Counter(), {s for s, _ in ones}
    for text, y in zip(texts, toxic):
        if not y:
            zeros.update(counted(text, among))
    n1, n0 = max(1, sum(map(bool, toxic))), max(1, len(toxic) - sum(map(bool, toxic)))
    good = {}
    for voter, a in ones.items():
        b = zeros[voter]
        if a / n1 < MIN_LIFT * (b + 0.5) / n0:
            continue
        expected = (a + b) * n1 / (n1 + n0)
        evidence = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))
        if evidence >= MIN_EVIDENCE:
            good[voter] = evidence
    holders: dict[tuple, set[int]] = {v: set() for v in good}
    among = {s for s, _ in good}
    for i, (text, y) in enumerate(zip(texts, toxic)):
        if y:
            for voter in counted(text, among):
                if voter in holders:
                    holders[voter].add(i)
    # twice over: a second cover gives each toxic text further voters
    chosen: list[str] = []
    for _ in range(2):
        covered: set[int] = set()
        while len(chosen) < most:
            free = [v for v in holders if not any(v[0].startswith(c) or c.startswith(v[0]) for c in chosen)]
            best = max(free, key=lambda v: (len(holders[v] - covered), good[v], len(v[0]), v), default=None)
            if best is None or len(holders[best] - covered) < 2:
                break
            covered |= holders[best]
            chosen.append(best[0])
    return sorted(chosen)


def label_model(votes: np.ndarray, prior: float, marks: np.ndarray, start: np.ndarray, importance: np.ndarray | None = None, trusted: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive class for each row of ``votes`` (rows, voters; 1 fired, 0 silent).

    A latent label makes each voter fire with a rate of its own per class;
    expectation-maximisation estimates the rates from all rows, those without a
    mark too, from the posteriors ``start`` on.  ``marks`` (1, 0, or nan where
    there is none) is the vote of a rater, whose rates are estimated in the
    same way, from marked rows, about ``LABEL_ERROR``.  Where two voters agree
    beyond what the label explains, their correlation is estimated from the
    residuals, and each voter's evidence is divided by one plus its
    correlations, so that near-copies of a voter count once.  ``importance``:
    how many rows of the corpus each row stands for.  Returns posteriors, rates
    (class, voter), these discounts, and the rater's rates of 1 by class.
    """
    x = votes.astype(float)
    stands = np.ones(len(x)) if importance is None else importance
    silent = (x.sum(axis=1) == 0).astype(float)
    known = ~np.isnan(marks)
    says = np.nan_to_num(marks)
    post = start.copy()
    weight = np.ones(x.shape[1])
    rates, rater = np.full((2, x.shape[1]), 0.5), np.array([LABEL_ERROR, 1 - LABEL_ERROR])
    silence = np.full(2, 0.5)
    base = math.log(prior / (1 - prior))
    for step in range(rounds):
        for c, p in enumerate((1 - post, post)):
            p = p * stands
            rates[c] = (p @ x + (0.5 if c or trusted is None else np.where(trusted, 0.05, 0.5))) / (p.sum() + 1.0)
            silence[c] = (p @ silent + 0.5) / (p.sum() + 1.0)
            at_first = LABEL_ERROR if c == 0 else 1 - LABEL_ERROR
            rater[c] = ((p * says)[known].sum() + LABEL_TRUST * at_first) / (p[known].sum() + LABEL_TRUST)
        if step in (4, 9):
            residual = x - (1 - post)[:, None] * rates[0] - post[:, None] * rates[1]
            spread = residual.T @ residual / max(len(x), 1)
            scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            # few rows in which both fire show little correlation
            both = x.T @ x
            correlation = np.abs(spread / scale[:, None] / scale[None, :]) * both / (both + 5)
            np.fill_diagonal(correlation, 0.0)
            weight = 1.0 / (1.0 + np.where(correlation > 0.3, correlation, 0.0).sum(axis=1))
        fire, quiet = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        hushed = np.maximum((1 - x) @ (weight * quiet), min(0.0, math.log(silence[1] / silence[0])))
        rated = np.where(known, np.where(says > 0, math.log(rater[1] / rater[0]), math.log((1 - rater[1]) / (1 - rater[0]))), 0.0)
        evidence = x @ (weight * fire) + hushed + rated + base
        post = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
    return post, rates, weight, rater


def logistic(x: np.ndarray, target: np.ndarray, importance: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for logistic regression on soft targets; the bias is not penalised."""
    full = np.hstack([x, np.ones((len(x), 1))])
    stands = np.ones(len(x)) if importance is None else importance
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (stands * (p - target)) + penalty * w
        curve = (full * (stands * p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str | None], toxic: list[int | None], counts: tuple[int, int] | None = None) -> Model:
    """Voters from the lexicon and from labelled texts, the label model over their votes on all texts, then the classifier.

    ``toxic`` holds None for texts without a label.  ``counts`` tells how many
    rows of the table are labelled 0 and 1 where ``texts`` has fewer: each row
    then stands for as many as it was drawn from, so that neither the prior nor
    the classifier's bias depends on how many are taken of either class.
    Without any labels the voters alone, by the lexicon at first, and a toxic
    share of ``PRIOR`` take their place.
    """
    marks = np.array([np.nan if t is None else float(bool(t)) for t in toxic], float)
    known = np.flatnonzero(~np.isnan(marks))
    stems = sorted({*LEXICON, *learn_stems([texts[i] for i in known], [int(marks[i]) for i in known])})
    finder = Finder(stems)
    votes = np.zeros((len(texts), len(LEVELS) * len(stems) + len(PATTERNS)))
    row, voter, rate = features(pa.array(texts, pa.string()), finder)
    votes[row, voter] = 1
    drawn = [int((marks == c).sum()) for c in (0, 1)]
    counts = counts or (drawn[0], drawn[1])
    prior = (counts[1] + 2 * PRIOR) / (sum(counts) + 2)
    each = np.array([counts[c] / drawn[c] if drawn[c] else 1.0 for c in (0, 1)])
    each *= len(known) / max(1.0, sum(n * e for n, e in zip(drawn, each)))
    importance = np.where(marks == 1, each[1], np.where(marks == 0, each[0], 1.0))
    native = np.isin(np.array(stems), LEXICON).repeat(len(LEVELS))
    start = math.log(prior / (1 - prior)) + 1.5 * votes[:, : len(native)][:, native].sum(axis=1) + np.nan_to_num((2 * marks - 1) * math.log((1 - LABEL_ERROR) / LABEL_ERROR))
    # voters that never fire tell nothing
    fires = votes.any(axis=0)
    trusted = np.append(native, np.zeros(len(PATTERNS), bool))[fires]
    post, *_ = label_model(votes[:, fires], prior, marks, 1 / (1 + np.exp(-np.clip(start, -30, 30))), importance, trusted)
    importance = importance * np.where(np.isnan(marks) & (len(known) > 0), UNLABELLED_WEIGHT, 1.0)
    weights, bias = logistic(np.hstack([votes, rate[:, None]]), post, importance)
    return Model(stems, weights, bias)


def learn(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH, unlabelled: int = UNLABELLED) -> Model:
    """Fit on up to ``each`` labelled texts of each class, outside the held-out fold, and up to ``unlabelled`` others.

    Of labels that share an id the larger counts; null ids and labels don't.
    Texts of the held-out fold serve without their labels like others.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rows = bounded_texts(docs, marks, "toxic", each)
    others = bounded_texts(docs, docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(0).alias("all")), "all", unlabelled)
    taken = {r.doc_id for r in rows}
    others = [r for r in others if r.doc_id not in taken]
    return fit([r.text for r in rows + others], [r.group for r in rows] + [None] * len(others), (counts.get(0, 0), counts.get(1, 0)))


def scores(texts: pa.Array, model: Model, finder: Finder) -> np.ndarray:
    row, voter, rate = features(texts, finder)
    z = model.bias + model.weights[-1] * rate + np.bincount(row, model.weights[voter], len(texts))
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity) for every row of ``docs``: the score from 0 to 1 of its whole text.

    A null text is scored like an empty one, by the bias alone.  Repeated rows
    come out as often as they went in; other columns are not read; an empty
    table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value.stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), held.value, finder))], ["doc_id", "toxicity"])

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return mapped(columns, run, "doc_id long, toxicity double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows whose text scores ``threshold`` or more; all columns stay and no row moves.

    A null text counts as empty.  Repeated rows stay or go together; an empty
    table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value.stems)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), held.value, finder) < threshold))

    return mapped(docs, run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


SQL: str | None = None
