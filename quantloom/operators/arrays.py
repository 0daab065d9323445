"""Feature arrays as matrices: Spark hands them over in Arrow batches and numpy works on whole blocks.

A row per element would cost a task far more than the elements themselves. Every function
given to Spark here is nested, so that it travels with its values and needs no package there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20  # elements of a block: 8 MB


def blocks_of(width: int, block: int = BLOCK) -> Callable:
    """A reader of Arrow batches: ``(rows x width, missing)`` per block of their first column.

    ``missing`` marks the null elements, which are NaN in the block, or is None where there are none.
    """
    rows = max(1, block // max(1, width))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            column = batch.column(0)
            if column.null_count:
                column = column.drop_null()
            for at in range(0, len(column) if width else 0, rows):
                flat = column.slice(at, rows).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
                gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width) if flat.null_count else None
                yield x, gone

    return read


def map_arrays(column: Column | str, change: Callable[[pa.Array], pa.Array], width: int) -> Column:
    """``change`` applied to the flat elements of whole arrays; it returns ``width`` elements per row.

    Null arrays stay null. Calls inside one another run as one Python step.
    """

    @F.arrow_udf("array<double>")
    def changed(rows: pa.Array) -> pa.Array:
        flat = change(rows.flatten())
        if rows.null_count:
            there = rows.is_valid().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(there * width)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), flat, mask=rows.is_null())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)

    return changed(column)


def pick_elements(column: Column | str, positions: Sequence[int], width: int) -> Column:
    """The elements at ``positions`` of arrays of ``width`` elements, in that order."""
    at = np.asarray(positions, dtype=np.int64)

    def pick(flat: pa.Array) -> pa.Array:
        starts = np.arange(len(flat) // max(1, width), dtype=np.int64) * width
        return flat.take(pa.array((starts[:, None] + at).ravel()))

    return map_arrays(column, pick, len(at))


def fill_elements(column: Column | str, fills: Sequence[float]) -> Column:
    """Null elements replaced by the value at their position."""
    fills = np.asarray(fills, dtype=float)
    width = len(fills)

    def fill(flat: pa.Array) -> pa.Array:
        if not flat.null_count:
            return flat
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
        return pa.array(np.where(gone, fills, x).ravel())

    return map_arrays(column, fill, width)


# Statistics -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stats:
    """Per feature: values, missing elements, least and greatest value, mean, squared deviations.

    NaN counts as a value and is the greatest; what has no values has NaN for all but the counts.
    """

    n: np.ndarray
    missing: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @property
    def rows(self) -> int:
        return int((self.n + self.missing).max(initial=0))

    @property
    def flat(self) -> np.ndarray:
        return self.low == self.high

    def variance(self, less: int = 1) -> np.ndarray:
        """Squared deviations over ``n - less``; NaN where that is not positive."""
        n = self.n - less
        found = np.full(len(n), np.nan)
        np.divide(np.where(self.flat, 0.0, self.m2), n, out=found, where=n > 0)
        return found

    def picked(self, positions: Sequence[int]) -> Stats:
        at = np.asarray(positions, dtype=int)
        return Stats(self.n[at], self.missing[at], self.low[at], self.high[at], self.mean[at], self.m2[at])

    def filled(self, fills: Sequence[float]) -> Stats:
        """Of the same rows with the missing elements at ``fills``."""
        fills = np.asarray(fills, dtype=float)
        some, none = self.missing > 0, self.n == 0
        rows = np.maximum(self.n + self.missing, 1)
        mean = np.where(none, fills, self.mean)
        apart = fills - mean
        return Stats(
            self.n + self.missing,
            np.zeros_like(self.missing),
            np.where(some, np.fmin(self.low, fills), self.low),
            np.where(some, np.where(none, fills, np.maximum(self.high, fills)), self.high),
            np.where(some, mean + apart * (self.missing / rows), self.mean),
            np.where(some, np.where(none, 0.0, self.m2 + apart * apart * (self.n / rows) * self.missing), self.m2),
        )


def feature_stats(df: DataFrame, column: str, width: int) -> DataFrame:
    """``(f, n, missing, low, high, mean, m2)`` per element position, in one pass without a row per element."""
    read = blocks_of(width)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, missing = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        low, high = np.full(width, np.nan), np.full(width, -np.inf)
        mean, m2 = np.zeros(width), np.zeros(width)
        with np.errstate(all="ignore"):
            for x, gone in read(batches):
                rows = len(x)
                count = np.full(width, rows) if gone is None else rows - gone.sum(axis=0)
                least = np.fmin.reduce(x, axis=0)
                most = (x if gone is None else np.where(gone, -np.inf, x)).max(axis=0)
                apart = x - least  # from the least value: exactly 0 in a constant feature
                if gone is not None:
                    apart[gone] = 0.0
                offset = apart.sum(axis=0) / np.maximum(count, 1)
                here = least + offset
                apart -= offset
                if gone is not None:
                    apart[gone] = 0.0
                squares = np.einsum("ij,ij->j", apart, apart)
                both, some = n + count, count > 0
                step = here - mean
                share = count / np.maximum(both, 1)
                mean = np.where(some, np.where(n > 0, mean + step * share, here), mean)
                m2 = np.where(some, m2 + squares + np.where(n > 0, step * step * share * n, 0.0), m2)
                low, high = np.fmin(low, least), np.where(some, np.maximum(high, most), high)
                n, missing = both, missing + (rows - count)
        seen = np.flatnonzero(n + missing > 0)
        values = [pa.array(v[seen], mask=n[seen] == 0) for v in (low, high, mean, m2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(missing[seen]), *values],
            names=["f", "n", "missing", "low", "high", "mean", "m2"],
        )

    schema = "f int, n long, missing long, low double, high double, mean double, m2 double"
    parts = df.select(column).mapInArrow(summarise, schema)
    part = F.when(F.col("n") > 0, F.struct(F.col("n").cast("double").alias("n"), "mean", "m2"))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / n
        first = a["n"] == 0
        return F.struct(
            n.alias("n"),
            F.when(first, b["mean"]).otherwise(a["mean"] + step * share).alias("mean"),
            F.when(first, b["m2"]).otherwise(a["m2"] + b["m2"] + step * step * share * a["n"]).alias("m2"),
        )

    merged = parts.groupBy("f").agg(
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.aggregate(F.collect_list(part), none, merge).alias("all"),  # one struct a task
    )
    known = F.col("n") > 0
    return merged.select(
        "f", "n", "missing", "low", "high", F.when(known, F.col("all.mean")).alias("mean"), F.when(known, F.col("all.m2")).alias("m2")
    )


_SHARED: ContextVar[dict | None] = ContextVar("shared_statistics", default=None)


@contextmanager
def shared_statistics():
    """Inside, the statistics of a table are computed once; outside, they are never kept."""
    if _SHARED.get() is not None:
        yield
        return
    token = _SHARED.set({})
    try:
        yield
    finally:
        _SHARED.reset(token)


def shared_stats(df: DataFrame, column: str) -> Stats | None:
    """What ``shared_statistics`` holds about a table."""
    held = (_SHARED.get() or {}).get((id(df), column))
    return held[1] if held else None


def share_stats(df: DataFrame, column: str, stats: Stats) -> None:
    """Note statistics that follow from those of the table ``df`` was made of."""
    if _SHARED.get() is not None:
        _SHARED.get()[id(df), column] = df, stats  # the table, so that its id stays its own


def stats_of(df: DataFrame, column: str, width: int) -> Stats:
    """Statistics of every element position, on the driver: one row per feature."""
    held = shared_stats(df, column)
    if held is not None:
        return held
    n, missing = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
    low, high, mean, m2 = (np.full(width, np.nan) for _ in range(4))
    for row in feature_stats(df, column, width).collect():
        f = row["f"]
        n[f], missing[f] = row["n"], row["missing"]
        if row["n"]:
            low[f], high[f], mean[f], m2[f] = row["low"], row["high"], row["mean"], row["m2"]
    stats = Stats(n, missing, low, high, mean, m2)
    share_stats(df, column, stats)
    return stats
