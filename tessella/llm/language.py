"""Language identification by a string kernel with Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_texts, documents, fold_of
from tessella.llm.textkernel import mapped, text_slices

#: n-grams of 1 to 4 bytes, each hashed into one of so many bins (by powers of two).
LONGEST = 4
BIN_BITS = 18
#: Texts to learn from and landmarks, for each language; texts in all, however many languages there are.
TRAIN_EACH = 300
LANDMARKS_EACH = 24
MOST_TRAIN = 20_000
RIDGE = 1e-3
#: Texts, and landmarks, that meet in one matrix product.
BATCH_ROWS = 64
LANDMARK_BLOCK = 96

# Letters of one case, with any run of other ASCII as a space.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_ANY_LETTER = r"\p{L}"


def lettered(texts: pa.Array) -> np.ndarray:
    """Which texts have any letter; null has none."""
    return pa.compute.match_substring_regex(texts, _ANY_LETTER).fill_null(False).to_numpy(zero_copy_only=False)


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text (rows) which bins its n-grams of 1 to 4 bytes hit: the blended spectrum, by presence."""
    n, bins = len(offsets) - 1, 1 << BIN_BITS
    hit = np.zeros(n * bins + 1, bool)
    body = _LETTERS[raw].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * bins, np.diff(offsets))
    code = np.zeros(len(body), np.uint32)
    for k in range(1, LONGEST + 1):
        count = len(body) - k + 1
        if count <= 0:
            break
        code = (code[:count] << np.uint32(8)) | body[k - 1 :]
        place = ((code * np.uint32(2654435761) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519)) >> np.uint32(32 - BIN_BITS)
        place = row[:count] + place
        if k > 1:
            # grams that begin in one text and end in the next
            late = offsets[1:-1, None] - np.arange(1, k)[None, :]
            late = late[(late >= offsets[:-2, None]) & (late < count)] if n > 1 else late[:0].ravel()
            place[late] = n * bins
        hit[place] = True
    return hit[:-1].reshape(n, bins)


def spectrum(texts: list[str]) -> np.ndarray:
    column = pa.array([t or "" for t in texts], pa.string())
    return np.concatenate([presence(raw, off) for _, _, raw, off in text_slices(column)] or [np.zeros((0, 1 << BIN_BITS), bool)])


class Landmarks:
    """Texts that all others are compared with, in blocks, each with the bins that any of its texts hits."""

    def __init__(self, texts: list[str]):
        self.number, self.blocks = len(texts), []
        for low in range(0, len(texts), LANDMARK_BLOCK):
            hit = spectrum(texts[low : low + LANDMARK_BLOCK])
            bins = np.flatnonzero(hit.any(axis=0))
            part = hit[:, bins].astype(np.float32)
            self.blocks.append((bins, part / np.sqrt(np.maximum(hit.sum(axis=1, keepdims=True), 1)).astype(np.float32)))

    def kernel(self, hit: np.ndarray) -> np.ndarray:
        """Shared bins of each text (rows of ``hit``) and landmark over the root of the product of their numbers."""
        size = np.sqrt(np.maximum(np.count_nonzero(hit, axis=1), 1))[:, None]
        return np.hstack([hit[:, bins].astype(np.float32) @ part.T for bins, part in self.blocks]) / size

    def of_column(self, texts: pa.Array) -> np.ndarray:
        """Kernel values (texts, landmarks), some texts at a time."""
        out = np.zeros((len(texts), self.number))
        for low in range(0, len(texts), BATCH_ROWS):
            for a, b, raw, offsets in text_slices(texts.slice(low, BATCH_ROWS)):
                out[low + a : low + b] = self.kernel(presence(raw, offsets))
        return out


@dataclass
class Classifier:
    """Kernel values against ``landmarks``, times ``weights``, give a score for each of ``languages``."""

    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray
    sharpness: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.sharpness * (self.landmarks.of_column(texts) @ self.weights))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], landmarks_each: int = LANDMARKS_EACH, ridge: float = RIDGE) -> Classifier | None:
    """One-versus-rest kernel ridge regression in the span of a few landmarks of each language.

    Landmarks are kept in blocks over the bins that they hit, and texts meet
    them some at a time, so that memory does not grow with the bins.
    Of the texts every fourth is left out of the regression, only to set how
    sharply scores turn into probabilities.  None without any text.
    """
    names = sorted(set(languages))
    if not names:
        return None
    which = np.array([names.index(x) for x in languages])
    picked = np.concatenate([np.flatnonzero(which == k)[:landmarks_each] for k in range(len(names))])
    held = np.arange(len(texts)) % 4 == 3
    if len(set(which[~held].tolist())) < len(names) or not held.any():
        held[:] = False
    landmarks = Landmarks([texts[i] for i in picked])
    kernel = landmarks.of_column(pa.array(texts, pa.string()))
    between = (kernel[picked] + kernel[picked].T) / 2
    value, vector = np.linalg.eigh(between)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    inside = kernel[~held] @ root
    goal = np.where(which[~held][:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    # each language counts the same, however many texts it has
    balance = 1.0 / np.bincount(which[~held], minlength=len(names))[which[~held]]
    balance *= len(balance) / balance.sum()
    gram = (inside * balance[:, None]).T @ inside + ridge * len(inside) * np.eye(inside.shape[1])
    weights = root @ np.linalg.solve(gram, (inside * balance[:, None]).T @ goal)
    test = held if held.any() else ~held
    scores, truth = kernel[test] @ weights, which[test]
    loss = {s: -np.log(np.maximum(softmax(s * scores)[np.arange(len(truth)), truth], 1e-12)).mean() for s in (1.0, 2.0, 4.0, 8.0, 16.0)}
    return Classifier(names, landmarks, weights, min(loss, key=loss.get))


def learn(docs: DataFrame, each: int = TRAIN_EACH, most: int = MOST_TRAIN) -> Classifier | None:
    """Fit on up to ``each`` texts a language, ``most`` in all, of rows outside the held-out fold whose lang is not null."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("language"))
    ids = ids.where(F.col("language").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    number = ids.select("language").distinct().count()
    rows = bounded_texts(docs, ids, "language", max(1, min(each, most // max(1, number))))
    rows = [r for r, good in zip(rows, lettered(pa.array([r.text for r in rows], pa.string()))) if good]
    return fit([r.text for r in rows], [r.group for r in rows], min(LANDMARKS_EACH, max(2, 2400 // max(1, number))))


def identify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, by whole texts.

    A text is the set of its n-grams of 1 to 4 bytes; the kernel of two texts
    is the number of shared bins over the root of the product of their sizes.
    Batches of texts meet all landmarks in one matrix product.  score is the
    probability of the language given.  A null text and one without letters
    are ``und`` with score 0, and so is every text where no model could be
    learned.  Repeated rows come out as often; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if model is not None:
                p = model.probabilities(batch.column(1))
                rows = np.flatnonzero(lettered(batch.column(1)))
                best = p.argmax(axis=1)[rows]
                names[rows] = np.array(model.languages, object)[best]
                score[rows] = np.round(p[rows, best], 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return mapped(columns, run, "doc_id long, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


SQL: str | None = None
