"""Student's t distribution for whole degrees of freedom, as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of ``t``; the finite trigonometric series for integer ``freedom``."""
    t, v = F.abs(t), freedom.cast("double")
    sine = t / F.sqrt(v + t * t)
    cosine2 = v / (v + t * t)
    odd = freedom % 2 == 1
    steps = F.floor(F.when(odd, (v - 3) / 2).otherwise((v - 2) / 2)).cast("int")

    def term(acc: Column, k: Column) -> Column:
        k = k.cast("double")
        factor = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        nxt = acc["term"] * factor * cosine2
        return F.struct(nxt.alias("term"), (acc["total"] + nxt).alias("total"))

    one = F.lit(1.0)
    series = F.when(
        steps >= 1,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
            F.struct(one.alias("term"), one.alias("total")),
            term,
            lambda acc: acc["total"],
        ),
    ).otherwise(one)
    inside_odd = (
        F.atan(t / F.sqrt(v)) + F.when(freedom > 1, sine * F.sqrt(cosine2) * series).otherwise(0.0)
    ) * (2 / math.pi)
    inside = F.when(odd, inside_odd).otherwise(sine * series)
    outside = F.when(inside > 1, 0.0).otherwise(1 - inside)
    return F.when(t == float("inf"), 0.0).otherwise(outside)
