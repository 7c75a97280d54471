"""Repeatable random draws.

``rand(seed)`` depends on how rows fall into partitions, so a retried task or a
different cluster size would change the data. A hash of the row id does not.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2**52


def hash_uniform(row_id: Column, seed: int, draw: int) -> Column:
    """Uniform double in (0, 1), a function of the row id, the seed and the draw number."""
    bits = F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(draw)), F.lit(_STEPS))
    return (bits.cast("double") + 0.5) / float(_STEPS)


def weighted_choice(u: Column, weights: Mapping[str, float]) -> Column:
    """Pick a name with probability proportional to its weight."""
    total = sum(weights.values())
    point, upper, choice = u * float(total), 0.0, None
    *head, last = weights
    for name in head:
        upper += weights[name]
        hit = point < F.lit(float(upper))
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return F.lit(last) if choice is None else choice.otherwise(last)
