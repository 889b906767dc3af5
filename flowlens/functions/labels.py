"""Label mapping as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schema import FINE_LABELS, NORMAL, UNKNOWN


def is_normal(label: Column, normal: str = NORMAL, match: str = "exact") -> Column:
    """True for normal records; ``match='prefix'`` accepts labels starting with it."""
    if match == "exact":
        return label == F.lit(normal)
    if match == "prefix":
        return label.startswith(normal)
    raise ValueError("match must be 'exact' or 'prefix'")


def coarse_label(label: Column, normal: str = NORMAL, match: str = "exact") -> Column:
    """0.0 for normal records, 1.0 for attacks, null for a missing label."""
    return F.when(is_normal(label, normal, match), F.lit(0.0)).when(
        label.isNotNull(), F.lit(1.0)
    )


def collapse_attacks(label: Column, normal: str = NORMAL, attack: str = "attack") -> Column:
    """Replace every label that does not start with ``normal`` by ``attack``."""
    return F.when(label.startswith(normal), label).when(label.isNotNull(), F.lit(attack))


def or_unseen(value: Column, label: Column, unseen: str) -> Column:
    """Fill labels without an entry: with ``unseen`` or, for ``'error'``, by failing."""
    if unseen == "error":
        fallback = F.raise_error(
            F.concat(F.lit("unseen label: "), F.coalesce(label, F.lit("null")))
        ).cast("string")
    else:
        fallback = F.lit(unseen)
    return F.coalesce(value, fallback)


def fine_label(
    label: Column,
    categories: dict[str, str] | None = None,
    unseen: str = UNKNOWN,
) -> Column:
    """Category of an attack label, looked up in a literal map."""
    categories = FINE_LABELS if categories is None else categories
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(categories.items())])
    return or_unseen(F.try_element_at(entries, label), label, unseen)
