"""Joins of a large table to one row per key, where one key may hold a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000  # rows of the large side a key keeps in one task before it is split
MAX_HOT_KEYS = 200_000  # hot keys broadcast at most; HOT_ROWS rises with the input to keep this


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` (one row per key, ``count`` rows of ``big`` each) on ``keys``.

    A key with more than ``HOT_ROWS`` rows of ``big`` is split: its rows go to ``ceil(count / HOT_ROWS)``
    salts by ``spread`` (a well-mixed number of each big row), and its one small row is copied
    to each salt, so no task joins more than about ``HOT_ROWS`` rows of one key. The list of hot
    keys is broadcast; it has at most total / HOT_ROWS entries, and the threshold rises so that
    it never exceeds ``MAX_HOT_KEYS``. Only the total reaches the driver.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, math.ceil(total / MAX_HOT_KEYS))
    hot = small.where(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__salts"))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.coalesce(F.pmod(spread, F.col("__salts")), F.lit(0)).cast("int")
    )
    copies = small.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    )
    return salted.drop("__salts").join(copies.drop("__salts"), [*keys, "__salt"], how).drop("__salt")
