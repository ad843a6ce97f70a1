"""Requests by method: a table of handlers, and snapshots of metrics at widening intervals."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize
from tessella.sources.folders import parsed_requests, responses


class Methods:
    """Handlers by name: each takes the rows of its requests and returns them with a column ``result`` (string).

    ``dispatch`` answers a batch; over a stream it serves as the function of
    foreachBatch.  What parses badly or names an unknown method gets an error.
    """

    def __init__(self):
        self._handlers: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}

    def register(self, name: str, handler: Callable[[DataFrame], DataFrame], usage: str = "") -> None:
        self._handlers[name] = handler, usage

    def unregister(self, name: str) -> bool:
        return self._handlers.pop(name, None) is not None

    def find(self, name: str) -> Callable[[DataFrame], DataFrame] | None:
        return self._handlers.get(name, (None, ""))[0]

    def usage(self) -> dict[str, str]:
        return {name: text for name, (_, text) in sorted(self._handlers.items())}

    def dispatch(self, lines: DataFrame) -> DataFrame:
        """(value): a reply for each request text in column value.

        A batch is parsed and written once, and only handlers of methods that
        it names are called.
        """
        parsed = parsed_requests(lines)
        known = parsed["request.method"].isin(list(self._handlers)) if self._handlers else F.lit(False)
        parsed = parsed.withColumn("error", F.coalesce("error", F.when(~known, F.concat(F.lit("unknown method "), F.col("request.method")))))
        parsed = materialize(parsed, "parsed")
        named = {r.method for r in parsed.where("error is null").select("request.method").distinct().collect()}
        columns = ["request", "error", "result"]
        out = parsed.where(F.col("error").isNotNull()).withColumn("result", F.lit(None).cast("string")).select(*columns)
        for name, (handler, _) in self._handlers.items():
            if name not in named:
                continue
            mine = parsed.where(F.col("error").isNull() & (F.col("request.method") == name))
            out = out.unionByName(handler(mine).withColumn("result", F.col("result").cast("string")).select(*columns))
        return responses(out, F.col("result"))


def definitions(tables: dict[str, DataFrame], wanted: dict[str, bool]) -> dict[str, DataFrame]:
    """The tables of a model that a request asks for."""
    return {name: df for name, df in tables.items() if wanted.get(name)}


class Snapshots:
    """Calls ``save(number, elapsed)`` the first time, and then each time the elapsed seconds have grown by ``factor``."""

    def __init__(self, save: Callable[[int, float], None], first: float = 60.0, factor: float = 1.5):
        self.save, self.due, self.factor, self.number = save, first, factor, 0

    def tick(self, elapsed: float, force: bool = False) -> bool:
        if not force and elapsed < self.due:
            return False
        self.save(self.number, elapsed)
        self.number += 1
        while self.due <= elapsed:
            self.due *= self.factor
        return True


class Progress:
    """For foreachBatch: says how far a stream is, at most once in ``seconds``, by ``say(batch, rows, elapsed)``."""

    def __init__(self, say: Callable[[int, int, float], None], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.say, self.seconds, self.clock, self.rows = say, seconds, clock, 0
        self.began = self.said = clock()

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.rows += batch.count()
        now = self.clock()
        if now - self.said >= self.seconds:
            self.said = now
            self.say(number, self.rows, now - self.began)
