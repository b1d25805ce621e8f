"""Seeded, order-free random keys of a row id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2147483647
# A Poisson(1) count above 21 has probability under 2^-64, less than one step of a 63-bit key.
MOST_DRAWS = 21


@dataclass(frozen=True)
class RandomKey:
    """A whole-number key in ``[0, space)`` that depends on the id and a seed only.

    The same row gets the same key whatever the partitioning, so samples, splits and folds
    repeat exactly and recomputed tasks agree. ``portable`` keys use integer arithmetic
    any SQL engine can repeat; they are weaker than the default 63-bit hash.
    """

    seed: int
    portable: bool = False

    @property
    def space(self) -> float:
        return float(_PRIME if self.portable else 2**63)

    def column(self, id_column: Column) -> Column:
        if not self.portable:
            return F.shiftrightunsigned(F.xxhash64(id_column, F.lit(self.seed)), 1)
        step = (id_column.cast("long") + F.lit(self.seed)) % _PRIME
        return step * 48271 % _PRIME * 16807 % _PRIME

    def slot(self, key_column: Column, slots: int | Column) -> Column:
        """Order-preserving slot 0..slots-1 of a key."""
        n = slots if isinstance(slots, Column) else F.lit(slots)
        return F.least(F.floor(key_column * (n / F.lit(self.space))), n.cast("long") - 1)


def poisson_weight(id_column: Column, seed: int, draw: int, key: RandomKey | None = None) -> Column:
    """Bootstrap count of a row in one draw: Poisson(1) by inversion of a hashed uniform."""
    source = key or RandomKey(seed * 1_000_003 + draw)
    u = source.column(id_column) / F.lit(source.space)
    weight, term, total = F.lit(None).cast("double"), 0.36787944117144233, 0.0
    for count in range(MOST_DRAWS):
        total += term
        weight = F.when(u < total, float(count)) if count == 0 else weight.when(u < total, float(count))
        term /= count + 1
    return weight.otherwise(float(MOST_DRAWS))
