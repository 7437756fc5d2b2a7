"""Number expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# A uniform number is the first twelve hexadecimal digits of an MD5 over this many values.
UNIFORM_SPAN = 1 << 48


def rounded(value: Column, digits: int = 6) -> Column:
    """Round; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def id_uniform(identity: Column, index: Column | int = 0, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by (id, index, seed), the same on every run and partitioning."""
    index = index if isinstance(index, Column) else F.lit(index)
    key = F.concat(identity.cast("long").cast("string"), F.lit(":"), index.cast("long").cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(UNIFORM_SPAN))


def uniform_value(identity: int, index: int = 0, seed: int = 0) -> float:
    """``id_uniform`` of plain numbers."""
    return int(md5(f"{identity}:{index}:{seed}".encode()).hexdigest()[:12], 16) / UNIFORM_SPAN


def folded_pareto(uniform: Column, skew: float, top: int) -> Column:
    """Pareto-like draw 0.2 / u**skew, cut to a whole number and folded into [0, top]."""
    draw = F.floor(F.lit(0.2) / F.pow(uniform, F.lit(float(skew)))).cast("long")
    return F.when(draw > F.lit(top), F.pmod(draw, F.lit(max(top, 1)))).otherwise(draw)


def unrolled_dot(left: Column, right: Column, size: int) -> Column:
    """Dot product of two short arrays of a known size, as one generated expression."""
    return reduce(add, [left[i] * right[i] for i in range(size)])
