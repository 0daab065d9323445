"""Exact quantiles of groups of any size.

``percentile`` keeps all distinct values of a group in one task, so it serves only groups of
checked size. Larger ones are narrowed first: approximate split points cut a group in cells,
the cells are counted exactly, and only the cell that holds the wanted rank goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import elements
from quantloom.operators.arrays import BLOCK, blocks_of, stats_of
from quantloom.session import materialise

GROUP_ROWS = 1_000_000
CELLS = 64
BROADCAST_TARGETS = 50_000
ACCURACY = 10_000  # of the sketch: ranks within n / ACCURACY; raised for large groups
BRACKET_ROWS = 250_000  # values a bracket should hold at most, about
MARGIN = 3  # sketch errors a bracket reaches on each side of its quantile
REACH = 4  # deviations of the rank of an array's sketch that a bracket reaches on each side


def exact_quantiles(
    df: DataFrame,
    value: str,
    qs: Sequence[float],
    by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    accuracy: int | None = None,
    margin: float = MARGIN,
) -> DataFrame:
    """Linearly interpolated quantiles: ``(*by, q, value)``; missing values are left out.

    Three passes over the values, none of which moves them all: a mergeable sketch per group
    (``percentile_approx``, partial aggregates only) brackets every wanted rank by two values;
    one pass counts the rows below each bracket and sends on only the values inside it, as
    (value, count); the bracket is then ranked exactly. A bracket that misses its rank, or that
    holds more than ``group_rows`` distinct values, is cut into cells until it fits, so results
    are exact whatever the sketch does. A null group key is a group of its own; a group with
    no value gives no row.
    """
    by = list(by)
    cell = F.to_json(F.struct(*by)) if by else F.lit("")
    values = df.select(*by, F.col(value).cast("double").alias("value")).where("value is not null").withColumn("cell", cell)
    if accuracy is None:
        largest = values.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        accuracy = int(min(1_000_000, max(ACCURACY, math.ceil(2 * margin * largest / BRACKET_ROWS))))
    wide = margin / accuracy
    probs = sorted({min(1.0, max(0.0, round(q + d, 12))) for q in qs for d in (-wide, wide)})
    stats = values.groupBy("cell", *by).agg(
        F.count("*").alias("n"), F.percentile_approx("value", probs, accuracy).alias("sketch")
    )
    at = (F.col("n") - 1) * F.col("q")
    spots = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(probs.index(min(1.0, max(0.0, round(q - wide, 12))))).alias("lo"), F.lit(probs.index(min(1.0, max(0.0, round(q + wide, 12))))).alias("hi")) for q in qs])
    targets = stats.select("cell", *by, "n", "sketch", F.explode(spots).alias("t")).select(
        "cell",
        *by,
        "n",
        F.col("t.q").alias("q"),
        # No bound where the bracket reaches past the ends of the group.
        F.when(F.col("t.q") - wide > 0, F.col("sketch")[F.col("t.lo")]).alias("lo"),
        F.when(F.col("t.q") + wide < 1, F.col("sketch")[F.col("t.hi")]).alias("hi"),
    )
    targets = targets.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    targets = materialise(targets, "targets")
    small = F.broadcast if targets.count() <= BROADCAST_TARGETS else lambda table: table
    bounds = targets.select("cell", "q", "lo", "hi").distinct()
    inside = (F.col("lo").isNull() | (F.col("value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    joined = values.select("cell", "value").join(small(bounds), "cell")
    counted = joined.groupBy("cell", "q").agg(
        F.sum((F.col("value") < F.col("lo")).cast("long")).alias("below"), F.sum(inside.cast("long")).alias("held")
    )
    targets = targets.join(counted, ["cell", "q"]).select(
        *by, "q", "n", "rank", "cell", F.coalesce("below", F.lit(0)).alias("skip"), F.coalesce("held", F.lit(0)).alias("held")
    )
    hit = (F.col("rank") - F.col("skip") >= 0) & (F.col("rank") - F.col("skip") < F.col("held"))
    targets = materialise(targets.withColumn("hit", hit), "targets")
    bracket = F.concat_ws("#", "cell", F.col("q").cast("string"))
    current = joined.where(inside).groupBy(bracket.alias("cell"), "value").agg(F.count("*").alias("c"))
    found = targets.where("hit").select(*by, "q", "n", "rank", bracket.alias("cell"), "skip")
    # The rare target its bracket missed takes its whole group again, from rank 0.
    whole = F.concat(bracket, F.lit("#all"))
    missed = targets.where("not hit").select(*by, "q", "n", "rank", whole.alias("cell"), F.lit(0).cast("long").alias("skip"))
    if missed.limit(1).count():
        again = values.join(small(targets.where("not hit").select("cell", "q").distinct()), "cell")
        current = current.unionByName(again.groupBy(whole.alias("cell"), "value").agg(F.count("*").alias("c")))
        found = found.unionByName(missed)
    return _interpolate(_refine(materialise(current, "distinct"), materialise(found, "targets"), by, group_rows, small), by)


def array_quantiles(
    df: DataFrame,
    column: str,
    width: int,
    qs: Sequence[float],
    group_rows: int = GROUP_ROWS,
    step: int | None = None,
    reach: float = REACH,
) -> DataFrame:
    """Linearly interpolated quantiles of every element position: ``(f, q, value)``; nulls are left out.

    As ``exact_quantiles`` by position, without a row per element. Every block of rows is sorted
    by position and leaves each ``step``-th value, which place each wanted rank between two
    values; a second pass counts what lies below them and sends on only the values between, as
    (value, count), which are ranked exactly. A rank its bracket missed takes its whole position
    again, so results are exact whatever the bracket is. Brackets grow with the 3/4th power of the rows.
    """
    qs = [float(q) for q in qs]
    rows = stats_of(df, column, width).rows
    if step is None:
        blocks = max(1.0, rows / max(1, BLOCK // max(1, width)))
        step = max(1, int(rows / max(4000.0, math.sqrt(2.3 * rows * math.sqrt(blocks)))))
    read = blocks_of(width)

    def lists(parts: list[np.ndarray], sizes: np.ndarray) -> list[pa.Array]:
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.array(p)) for p in parts]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks are alike: begun at one place, their errors would add up instead of cancelling out.
        phase = np.random.default_rng(TaskContext.get().partitionId())
        for x, gone in read(batches):
            ordered = np.sort(x.T, axis=1)  # nulls last, after any NaN
            known = np.full(width, len(x)) if gone is None else len(x) - gone.sum(axis=0)
            starts = np.arange(-phase.integers(step), len(x), step)
            begin = np.maximum(starts, 0)
            weight = np.maximum(np.minimum(starts + step, known[:, None]) - begin, 0)
            value = np.take_along_axis(ordered, np.minimum(begin + weight // 2, len(x) - 1), axis=1)
            held = weight > 0
            made = lists([value[held], weight[held].astype(np.int64)], held.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *made], names=["f", "value", "weight"])

    def bracket(table: pa.Table) -> pa.Table:
        parts = [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("value", "weight")]
        order = np.argsort(parts[0], kind="stable")
        value, weight = parts[0][order], parts[1][order]
        place = np.cumsum(weight) - weight / 2
        n, blocks = int(weight.sum()), len(table)
        off = step * (1 + min(blocks / 2, reach * math.sqrt(blocks / 12))) if reach else 0
        low, high = [], []
        for q in qs if n else ():
            at = (n - 1) * q
            i = int(np.searchsorted(place, math.floor(at) - off, "right")) - 1
            j = int(np.searchsorted(place, math.ceil(at) + 1 + off, "left"))
            # No bound where the bracket reaches past the ends; NaN is above all.
            low.append(None if i < 0 else float(value[i]))
            high.append(None if j >= len(value) or np.isnan(value[j]) else float(value[j]))
        size = len(low)
        f = [table["f"][0].as_py()] * size
        return pa.table(
            {"f": pa.array(f, pa.int32()), "q": pa.array(qs[:size], pa.float64()), "n": pa.array([n] * size, pa.int64()),
             "lo": pa.array(low, pa.float64()), "hi": pa.array(high, pa.float64())}
        )

    points = df.select(column).mapInArrow(sketch, "f int, value array<double>, weight array<long>")
    schema = "f int, q double, n long, lo double, hi double"
    found = points.groupBy("f").applyInArrow(bracket, schema).collect()  # one row per position and quantile
    if not found:
        return df.sparkSession.createDataFrame([], "f int, q double, value double")
    targets = [(r["f"], r["q"], r["n"], r["lo"], r["hi"]) for r in found]
    bounds = []  # per quantile: lower and upper bound, whether open above, number of the target
    for q in dict.fromkeys(qs):
        lo, hi, above, at = np.full(width, np.inf), np.full(width, -np.inf), np.zeros(width, dtype=bool), np.full(width, -1)
        for t, (f, q_, _, low, high) in enumerate(targets):
            if q_ == q:
                lo[f] = -np.inf if low is None else np.inf if np.isnan(low) else low
                hi[f], above[f], at[f] = (np.inf if high is None else high), high is None, t
        bounds.append((lo, hi, above, at))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, gone in read(batches):
            for lo, hi, above, at in bounds:
                below = x < lo
                held = ~below & ((x <= hi) | above) & (at >= 0)
                if gone is not None:
                    held &= ~gone
                count = held.sum(axis=0)
                position = np.repeat(np.arange(width), count)
                value = x.T[held.T] + 0.0
                order = np.lexsort((value, position))
                value = value[order]
                new = np.ones(len(value), dtype=bool)
                new[1:] = (position[1:] != position[:-1]) | (value[1:] != value[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(value)))
                seen = np.flatnonzero(at >= 0)
                made = lists([value[first], times], np.bincount(position[first], minlength=width)[seen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[seen]), pa.array(below.sum(axis=0)[seen]), pa.array(count[seen]), *made],
                    names=["t", "below", "held", "value", "c"],
                )

    schema = "t long, below long, held long, value array<double>, c array<long>"
    stored = materialise(df.select(column).mapInArrow(between, schema), "brackets")
    sums = stored.groupBy("t").agg(F.sum("below").alias("below"), F.sum("held").alias("held")).collect()
    sums = {r["t"]: (r["below"], r["held"]) for r in sums}
    placed, missed = [], set()
    for t, (f, q, n, _, _) in enumerate(targets):
        below, held = sums.get(t, (0, 0))
        for rank in {math.floor((n - 1) * q), math.ceil((n - 1) * q)}:
            hit = 0 <= rank - below < held
            placed.append((f, q, n, rank, f"{t}" if hit else f"{f}#all", below if hit else 0))
            if not hit:
                missed.add(f)
    pairs = F.explode(F.arrays_zip("value", "c")).alias("p")
    current = stored.select(F.col("t").cast("string").alias("cell"), pairs).groupBy("cell", F.col("p.value").alias("value"))
    current = current.agg(F.sum("p.c").alias("c"))
    if missed:
        again = df.select(elements(column)).where(F.col("f").isin(sorted(missed)) & F.col("x").isNotNull())
        cell = F.concat(F.col("f").cast("string"), F.lit("#all")).alias("cell")
        current = current.unionByName(again.groupBy(cell, F.col("x").alias("value")).agg(F.count("*").alias("c")))
    wanted = df.sparkSession.createDataFrame(placed, "f int, q double, n long, rank long, cell string, skip long")
    small = F.broadcast if len(placed) <= BROADCAST_TARGETS else lambda table: table
    return _interpolate(_refine(materialise(current, "distinct"), wanted, ["f"], group_rows, small), ["f"])


def _refine(current: DataFrame, targets: DataFrame, by, group_rows, small) -> DataFrame:
    """Values at the ranks of ``targets`` ``(*by, q, n, rank, cell, skip)`` among ``current``
    ``(cell, value, c)``: cells above ``group_rows`` distinct values are cut by approximate
    split points and counted until they fit, then ranked exactly."""
    while (_largest(current) or 0) > group_rows:
        splits = current.groupBy("cell").agg(
            F.array_distinct(
                F.percentile_approx("value", [i / CELLS for i in range(1, CELLS)], F.lit(4 * CELLS))
            ).alias("splits")
        )
        cut = current.join(small(splits), "cell").select(
            "cell", "value", "c",
            F.size(F.filter("splits", lambda s: s < F.col("value"))).alias("part"),
        )
        counted = cut.groupBy("cell", "part").agg(F.sum("c").alias("rows"))
        before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("below", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        placed = targets.join(counted, "cell").where(
            (F.col("rank") - F.col("skip") >= F.col("below"))
            & (F.col("rank") - F.col("skip") < F.col("below") + F.col("rows"))
        )
        targets = materialise(
            placed.select(
                *by, "q", "n", "rank",
                F.concat_ws("/", "cell", "part").alias("cell"),
                (F.col("skip") + F.col("below")).alias("skip"),
            ),
            "targets",
        )
        wanted = small(targets.select("cell").distinct())
        current = materialise(
            cut.select(F.concat_ws("/", "cell", "part").alias("cell"), "value", "c").join(
                wanted, "cell", "left_semi"
            ),
            "narrowed",
        )
    running = Window.partitionBy("cell").orderBy("value")
    ranked = current.withColumn("upto", F.sum("c").over(running))
    inside = (F.col("rank") - F.col("skip") < F.col("upto")) & (
        F.col("rank") - F.col("skip") >= F.col("upto") - F.col("c")
    )
    return targets.join(ranked, "cell").where(inside).select(*by, "q", "n", "rank", "value")


def _largest(current: DataFrame) -> int:
    return current.groupBy("cell").count().agg(F.max("count")).first()[0]


def _interpolate(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    at = (F.col("n") - 1) * F.col("q")
    return (
        ranked.groupBy(*by, "q", "n")
        .agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
        .select(
            *by, "q", (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("value")
        )
    )
