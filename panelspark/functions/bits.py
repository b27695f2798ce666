"""Item sets as one BIGINT: bit ``i`` is catalogue item ``i``.

Moving 8 bytes per (entity, period) in place of one column or one row per item is
what keeps the window shuffle small; rows per item appear only where a result needs them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_column(item: Column, items: Sequence[str]) -> Column:
    """Bit of one item name; null for a name outside the catalogue."""
    pairs = [x for i, name in enumerate(items) for x in (F.lit(name), F.lit(1 << i).cast("long"))]
    return F.create_map(*pairs)[item]


def known_mask(item: Column, items: Sequence[str]) -> Column:
    """``mask_column`` that fails on a name outside the catalogue; null stays null."""
    mask = mask_column(item, items)
    unknown = F.raise_error(F.concat(F.lit("item outside the catalogue: "), item)).cast("long")
    return F.when(item.isNotNull() & mask.isNull(), unknown).otherwise(mask)


def bits_of(flags: Sequence[Column]) -> Column:
    """Pack 0/1 columns, given in catalogue order; a null flag counts as not held."""
    packed = F.lit(0).cast("long")
    for i, flag in enumerate(flags):
        packed = packed.bitwiseOR(F.when(flag == 1, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return packed


def has_item(bits: Column, index: Column | int) -> Column:
    """1 if item ``index`` is in the set, else 0."""
    position = F.lit(index) if isinstance(index, int) else index
    return F.getbit(bits, position).cast("int")


def item_numbers(bits: Column, n: int) -> Column:
    """Catalogue positions present in the set, ascending."""
    return F.filter(F.lit(list(range(n))), lambda i: has_item(bits, i) == 1)


def names_of(numbers: Column, items: Sequence[str]) -> Column:
    """Item names for an array of catalogue positions."""
    catalogue = F.array(*[F.lit(x) for x in items])
    return F.transform(numbers, lambda i: F.get(catalogue, i))


def held_names(bits: Column, items: Sequence[str]) -> Column:
    return names_of(item_numbers(bits, len(items)), items)


TENURE_PERIODS = 6


def tenure_of(recent_states: Column, index: Column | int, periods: int = TENURE_PERIODS) -> Column:
    """In how many of the recent periods the item was held.

    Written out per period: a lambda over the array would leave generated code.
    """
    held = [F.coalesce(has_item(F.get(recent_states, j), index), F.lit(0)) for j in range(periods)]
    return reduce(lambda a, b: a + b, held)
