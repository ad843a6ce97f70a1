"""Names of methods, losses and other choices, and free metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in files, by number.
OPTIMISATION = (
    "cutting_plane", "cutting_plane_1slack", "SGD", "SGD_pegasos", "online_dual_ascent", "online_dual_ascent_with_cache", "multi_sample", "multi_sample_with_cache",
    "binary_classification", "mine_hard_negatives", "fixed_sample_set",
)
#: Another name that readers take.
ALIASES = {"online_dual_update": "online_dual_ascent"}
DETECTION_LOSS = ("intersection_parts", "intersection_object", "num_click_std_dev", "num_parts_incorrect", "detection")
QUESTION_SELECT = ("information_gain", "information_gain_per_second", "random")
UNKNOWN = "unknown"


def name_of(number: Column, names: tuple[str, ...]) -> Column:
    """The name of a number; 'unknown' beyond the list and for null."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), number.cast("int")), F.lit(UNKNOWN))


def number_of(name: Column, names: tuple[str, ...], aliases: dict[str, str] | None = None) -> Column:
    """The number of a name or of what it is an alias of; null for others."""
    table = {n: k for k, n in enumerate(names)}
    table |= {a: table[n] for a, n in (aliases or {}).items()}
    return F.try_element_at(F.create_map(*[F.lit(v) for n, k in table.items() for v in (n, k)]), name)


def with_meta(meta: Column, key: str, value: Column) -> Column:
    """Metadata (a map of strings) with one key set anew; null counts as empty."""
    old = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def meta(meta: Column, key: str) -> Column:
    return F.try_element_at(meta, F.lit(key))
