"""Hash-keyed randomness: every draw is a pure function of a row key and a seed.

``rand()`` depends on partitioning; these values do not, so a sample, a fold
or a bootstrap weight is the same after a lost executor or on another cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SPAN = float(1 << 32)


def hash32(seed: int | str | Column, *keys: Column) -> Column:
    """First 32 bits of md5(key|...|seed) as a bigint in [0, 2^32)."""
    salt = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[k.cast("string") for k in keys], salt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *keys: Column) -> Column:
    """A number strictly inside (0, 1)."""
    return (hash32(seed, *keys) + F.lit(0.5)) / F.lit(_SPAN)


EXACT_BELOW = 32


def _poisson_table(below: int) -> str:
    """SQL array of the Poisson distribution functions of means 0 .. below-1, up to where they reach 1."""
    rows = []
    for mean in range(below):
        p = cdf = math.exp(-mean)
        row = [cdf]
        for k in range(1, int(mean + 12 * math.sqrt(mean) + 16)):
            p *= mean / k
            cdf += p
            row.append(cdf)
        rows.append("array(" + ", ".join(f"{c!r}D" for c in row) + ")")
    return "array(" + ", ".join(rows) + ")"


def poisson_count(mean: Column, seed: int | str, *keys: Column) -> Column:
    """One Poisson draw per key; ``mean`` is a count.

    Small means invert the tabled distribution function; larger ones use the
    Cornish-Fisher expansion of the Poisson quantile, whose error is
    O(1/sqrt(mean)) of one count.
    """
    u = uniform(f"{seed}|u", *keys)
    row = F.element_at(F.expr(_poisson_table(EXACT_BELOW)), mean.cast("int") + 1)
    # entries below u = place of u among them; a lambda would hash again for every entry
    small = F.array_position(F.sort_array(F.array_append(row, u)), u) - 1
    z = F.sqrt(-2.0 * F.log(uniform(f"{seed}|r", *keys))) * F.cos(
        F.lit(6.283185307179586) * uniform(f"{seed}|a", *keys)
    )
    large = F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5)
    return F.when(mean < EXACT_BELOW, small).otherwise(F.greatest(large, F.lit(0).cast("bigint")))
