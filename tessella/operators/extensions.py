"""What users can plug in: structured models, kinds of questions, features of windows, distances and orders."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame

from tessella.operators import training
from tessella.operators.training import Parameters


class StructuredModel(ABC):
    """A structured problem: override ``scores`` and, where wanted, the hooks; training and evaluation come with it.

    ``scores(examples, weights)`` gives (example, gt, label, score, loss), a row
    for each label that an example may have.  ``features(samples)`` gives
    (example, label, index, value), the joint features.  Both are DataFrames,
    so that inference is planned and distributed by the engine.
    """

    parameters: Parameters = Parameters()

    @abstractmethod
    def scores(self, examples: DataFrame, weights: DataFrame) -> DataFrame:
        """(example, gt, label, score, loss)."""

    @abstractmethod
    def features(self, samples: DataFrame) -> DataFrame:
        """(example, label, index, value) of samples (example, label)."""

    def initial_samples(self, examples: DataFrame, weights: DataFrame) -> DataFrame | None:
        """Samples (example, label) that every set has from the start; none, unless overridden."""
        return None

    def finished_round(self, number: int, objective: float) -> None:
        """Called after each round."""

    def inferred(self, examples: DataFrame, weights: DataFrame, with_loss: bool = False) -> DataFrame:
        """(example, label, loss, score, slack): the best label by score, or by score and loss."""
        found = self.scores(examples, weights)
        return training.most_violated(found if with_loss else found.withColumn("loss", found["loss"] * 0))

    def importance_samples(self, examples: DataFrame, weights: DataFrame) -> DataFrame:
        """The sample that violates most, for each example."""
        return self.inferred(examples, weights, with_loss=True)

    def train(self, examples: DataFrame, weights: DataFrame, rounds: int) -> DataFrame:
        """(index, value) of the weights after rounds of subgradient steps over all examples at once."""
        from pyspark.sql import functions as F

        from tessella.operators.learning import gradient_step
        from tessella.session import materialize

        for number in range(1, rounds + 1):
            found = materialize(self.scores(examples, weights), "scores")
            worst = training.most_violated(found)
            truth = found.where("label = gt").select("example", "label")
            bad = self.features(worst.select("example", "label")).withColumn("value", -F.col("value"))
            samples = self.features(truth).unionByName(bad)
            weights = materialize(gradient_step(samples, weights, self.parameters.regulariser, number), "weights")
            self.finished_round(number, worst.agg(F.avg("slack")).first()[0] or 0.0)
        return weights


class Registry:
    """Things by name; a name that is taken is refused unless it is to be replaced."""

    def __init__(self, what: str):
        self.what, self._held = what, {}

    def register(self, name: str, thing: object, replace: bool = False) -> None:
        if name in self._held and not replace:
            raise KeyError(f"{self.what} {name} is registered already")
        self._held[name] = thing

    def unregister(self, name: str) -> bool:
        return self._held.pop(name, None) is not None

    def find(self, name: str) -> object:
        if name not in self._held:
            raise KeyError(f"no {self.what} {name}; known: {', '.join(sorted(self._held))}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


@dataclass
class QuestionKind:
    """How a kind of question is answered: joint weights of answers and classes, and what a test example says.

    ``answers(priors, model, questions)``: (session, question, .., class, u);
    ``told(responses, questions)``: (example, question, ..).
    """

    answers: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    told: Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class WindowFeature:
    """A feature of a map: ``compute`` makes an array (height, width, channels) out of an image, ``width`` numbers a cell."""

    compute: Callable[[np.ndarray], np.ndarray]
    channels: int
    options: dict = field(default_factory=dict)


QUESTIONS, FEATURES, DISTANCES, ORDERS = Registry("question"), Registry("feature"), Registry("distance"), Registry("order")


def _known() -> None:
    from tessella.functions import vectors
    from tessella.operators import game, grids, lookups, ordering

    QUESTIONS.register("binary", QuestionKind(lambda p, m, q: game.binary_answers(p, m.join(q.select("attribute"), "attribute", "left_semi")), lambda r, q: r.join(q.select("question", "attribute"), "attribute")))
    QUESTIONS.register("multiple", QuestionKind(lambda p, m, q: game.choice_answers(p, m, q.select("question", "attribute")), lookups.chosen_answers))
    QUESTIONS.register("batch", QuestionKind(lambda p, m, q: game.batch_answers(p, m, q.select("question", "attribute")), lookups.batch_told))
    FEATURES.register("histogram", WindowFeature(grids.oriented_histograms, 9))
    FEATURES.register("patterns", WindowFeature(lambda a: np.dstack(grids.binary_patterns(a)), 2))
    FEATURES.register("plain", WindowFeature(lambda a: a[..., None] if a.ndim == 2 else a, 1))
    ORDERS.register("class", lambda: ordering.by_class("class", "example"))
    ORDERS.register("score", lambda: ordering.by_score("score", "example"))
    ORDERS.register("loss", lambda: ordering.by_loss("loss", "example"))
    for known in (vectors.l1, vectors.l2, vectors.l2_squared, vectors.chi_squared):
        DISTANCES.register(known.__name__, known)


_known()


def distance(name: str, a: Column, b: Column) -> Column:
    return DISTANCES.find(name)(a, b)
