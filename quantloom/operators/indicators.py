"""Row-ordered indicators of every feature column.

All families share one physical plan: wide rows are shuffled once by block, features are
turned into rows inside the block (``posexplode`` keeps the partitioning), and every frame
is computed by windows over ``(block, feature)``. Each base statistic is computed once and
the dependent ones are projections of it. ``indicator_arrays`` computes the same from the same
blocks by numpy, without a row per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quantloom.functions import elements, finite, full_window, ratio
from quantloom.operators.ordering import block_rows_for, carried_values, dense_rows, with_halo, with_row_id
from quantloom.roles import Roles, feature_columns
from quantloom.session import shuffle_partitions

LAGS = (1, 2, 3)
LOOKBACKS = (5, 10, 20)
RETURNS = (1, 2, 5, 10)
ROC = (3, 7, 14)
TREND = (10, 20)
QUANTILE_WINDOWS = (50, 100)
ROLLING = ("mean", "std", "min", "max", "zscore", "pct_from_mean")
DISPERSION = ("volatility", "atr", "cv")
QUANTILES = ("q25", "q75", "iqr", "above_q75", "below_q25")
FLAGS = ("above_q75", "below_q25")


@dataclass(frozen=True)
class IndicatorSet:
    """Which indicators to compute; windows are counted in rows.

    ``fill='pad'`` carries the last value over gaps before taking returns, ``None`` does not.
    """

    lags: Sequence[int] = ()
    windows: Sequence[int] = ()
    stats: Sequence[str] = ROLLING
    returns: Sequence[int] = ()
    momentum: Sequence[int] = ()
    roc: Sequence[int] = ()
    trend: Sequence[int] = ()
    dispersion_windows: Sequence[int] = ()
    dispersion: Sequence[str] = DISPERSION
    quantile_windows: Sequence[int] = ()
    quantiles: Sequence[str] = QUANTILES
    fill: str | None = "pad"

    @property
    def look_back(self) -> int:
        reach = [0, *self.lags, *self.returns, *self.momentum, *self.roc, *self.dispersion_windows]
        reach += [w - 1 for w in (*self.windows, *self.trend, *self.quantile_windows)]
        return max(reach)

    @property
    def needs_returns(self) -> bool:
        return bool(self.returns) or bool(self.dispersion_windows and "volatility" in self.dispersion)

    def outputs(self) -> dict[str, list[str]]:
        """Output names (without the feature name) of each family, in column order."""
        return {
            "lag": [f"lag_{k}" for k in self.lags],
            "rolling": [f"{s}_{w}" for w in self.windows for s in self.stats],
            "momentum": [f"return_{w}" for w in self.returns]
            + [f"momentum_{w}" for w in self.momentum]
            + [f"roc_{w}" for w in self.roc]
            + [f"trend_{w}" for w in self.trend],
            "volatility": [f"{s}_{w}" for w in self.dispersion_windows for s in self.dispersion],
            "quantile": [f"{s}_{w}" for w in self.quantile_windows for s in self.quantiles],
        }

    def names(self) -> list[str]:
        return [n for family in self.outputs().values() for n in family]


ALL_INDICATORS = IndicatorSet(
    lags=LAGS,
    windows=LOOKBACKS,
    returns=RETURNS,
    momentum=LOOKBACKS,
    roc=ROC,
    trend=TREND,
    dispersion_windows=LOOKBACKS,
    quantile_windows=QUANTILE_WINDOWS,
)


def feature_blocks(
    df: DataFrame, r: Roles, wanted: IndicatorSet, keep: Sequence[str], block_rows: int | None, rows: int
) -> tuple[DataFrame, Column]:
    """Wide rows in partitions of whole blocks, ``block, row_id, own, *keep, xs``, and their place in the block.

    ``row_id`` must count the ``rows`` rows without holes.
    """
    names = feature_columns(df, r.features)
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    look_back = wanted.look_back
    if block_rows is None:
        block_rows = block_rows_for(rows, look_back, max(parts, spark.sparkContext.defaultParallelism))
        parts = min(parts, rows // block_rows + 1)
    wide = df.select(
        r.row_id, *keep, F.array(*[finite(F.col(c).cast("double")) for c in names]).alias("xs")
    )
    blocks = with_halo(wide, r.row_id, look_back, block_rows)
    if wanted.needs_returns and wanted.fill == "pad":
        # The value carried into a block enters as one more row before its halo.
        carried = carried_values(wide, r.row_id, "xs", look_back, block_rows).select(
            (F.col("block") * block_rows - look_back - 1).alias(r.row_id),
            "block",
            "xs",
            F.lit(False).alias("own"),
        )
        blocks = blocks.unionByName(carried, allowMissingColumns=True)
    # Position from the block's start: a slope is shift-invariant, its precision is not.
    at = (F.col(r.row_id) - F.col("block") * block_rows).cast("double").alias("at")
    return blocks.repartition(parts, "block"), at


def feature_rows(
    df: DataFrame, r: Roles, wanted: IndicatorSet, keep: Sequence[str], block_rows: int | None, rows: int
) -> DataFrame:
    """One row per (block, row, feature): ``block, row_id, own, at, *keep, f, x``."""
    blocks, at = feature_blocks(df, r, wanted, keep, block_rows, rows)
    return blocks.select("block", r.row_id, "own", at, *keep, elements("xs"))


def indicator_arrays(
    df: DataFrame,
    r: Roles,
    wanted: IndicatorSet,
    keep: Sequence[str],
    groups: Sequence[Sequence[str]],
    block_rows: int | None,
    rows: int,
) -> DataFrame:
    """What ``indicator_rows`` computes, one row per row: ``row_id, *keep, xs, group_0, group_1, ...``.

    Each of ``groups`` names families; their outputs lie side by side in its array, by family,
    feature and output. Blocks stream through numpy in order of their rows, so a task holds
    some rows of a block and the look-back before them. ``row_id`` must count the rows without holes.
    """
    width, families = len(feature_columns(df, r.features)), wanted.outputs()
    names = [[families[f] for f in group if families[f]] for group in groups]
    derive = _block_indicators(names, wanted.look_back, wanted.fill == "pad")
    total = sum(len(outputs) for group in names for outputs in group)
    most = max(256, _CHUNK // (width * max(1, total)))
    blocks, at = feature_blocks(df, r, wanted, keep, block_rows, rows)
    ordered = blocks.select("block", "own", at, "xs", r.row_id, *keep).sortWithinPartitions("block", r.row_id)
    labels = [f"group_{i}" for i in range(len(groups))]

    def lists(values: np.ndarray) -> pa.ListArray:
        values[~np.isfinite(values)] = np.nan
        ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), from_pandas=True))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, earlier = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                blocks = part.column(0).to_numpy()
                own = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                place = part.column(2).to_numpy()
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
                made = []
                for a, b in zip(edges, edges[1:]):
                    if blocks[a] != block:
                        block, earlier = blocks[a], None
                    values, earlier = derive(x[a:b], place[a:b], earlier)
                    made.append([v[own[a:b]] for v in values])
                kept = part.filter(pa.array(own))
                arrays = [lists(np.concatenate([m[i] for m in made])) for i in range(len(labels))]
                columns = [kept.column(i) for i in range(4, kept.num_columns)] + [kept.column(3), *arrays]
                yield pa.RecordBatch.from_arrays(columns, names=out)

    fields = [ordered.schema[c] for c in (r.row_id, *keep)]
    fields += [StructField(c, ArrayType(DoubleType())) for c in ("xs", *labels)]
    out = [f.name for f in fields]
    return ordered.mapInArrow(stream, StructType(fields))


_CHUNK = 1 << 21  # derived values at a time: 16 MB


def _block_indicators(groups: list[list[list[str]]], look_back: int, pad: bool) -> Callable:
    """A function of some rows of a block: their outputs, and what the block's next rows need of them.

    Sums run from a window's oldest row to its newest, as Spark's do. A missing value is NaN and
    makes what is computed of it NaN. Nested throughout, as it travels to the tasks by value.
    """
    reach = look_back + 1

    def ratio_of(a, b):
        return np.where(b == 0, np.nan, a / b)

    def derive(x, at, earlier):
        n, width = x.shape
        if earlier is None:
            nothing = np.full((reach, width), np.nan)
            earlier = nothing, np.full(reach, np.nan), nothing
        xs = np.concatenate([earlier[0], x])
        ats = np.concatenate([earlier[1], at])
        filled = np.concatenate([earlier[2], x])
        if pad:
            last = np.where(np.isnan(filled), 0, np.arange(len(filled))[:, None])
            filled = np.take_along_axis(filled, np.maximum.accumulate(last, axis=0), axis=0)
        made: dict = {}

        def back(v, rows):
            return v[reach - rows : reach - rows + n]

        def window(v, size):
            return [back(v, size - 1 - i) for i in range(size)]

        def once(key, compute, *args):
            if key not in made:
                made[key] = compute(*args)
            return made[key]

        def mean(size):
            rows = window(xs, size)
            total = rows[0]
            for row in rows[1:]:
                total = total + row
            return total / size

        def lowest(size):
            return np.minimum.reduce(window(xs, size))

        def highest(size):
            return np.maximum.reduce(window(xs, size))

        def deviation_of(v, size):
            rows, avg, m2 = window(v, size), 0.0, 0.0
            for i, row in enumerate(rows):
                apart = row - avg
                part = apart / (i + 1.0)
                avg, m2 = avg + part, m2 + apart * (apart - part)
            flat = np.minimum.reduce(rows) == np.maximum.reduce(rows)
            return np.where(flat, 0.0, np.sqrt(m2 / (size - 1.0)) if size > 1 else np.nan)

        def slope(size):
            t, y, c, m2 = 0.0, 0.0, 0.0, 0.0
            for i, (place, row) in enumerate(zip(window(ats[:, None], size), window(xs, size))):
                count, dt = i + 1.0, place - t
                part = dt / count
                t, y = t + part, y + (row - y) / count
                c, m2 = c + dt * (row - y), m2 + dt * (dt - part)
            return ratio_of(c, m2)

        def quartiles(size):
            rows = np.stack(window(xs, size), axis=-1)
            whole = ~np.isnan(rows).any(axis=-1)
            rows = np.sort(rows, axis=-1)
            found = []
            for q in (0.25, 0.75):
                spot = (size - 1) * q
                low = rows[..., int(spot)]
                step = rows[..., min(int(spot) + 1, size - 1)] - low
                found.append(np.where(whole, low + step * (spot - int(spot)), np.nan))
            return found

        def gains():
            found = np.full_like(filled, np.nan)
            found[1:] = ratio_of(filled[1:], filled[:-1]) - 1
            return found

        def output(name):
            kind, size = name.rsplit("_", 1)
            w = int(size)
            match kind:
                case "lag":
                    return back(xs, w)
                case "mean":
                    return once(("mean", w), mean, w)
                case "std":
                    return once(("std", w), deviation_of, xs, w)
                case "min":
                    return once(("min", w), lowest, w)
                case "max":
                    return once(("max", w), highest, w)
                case "zscore":
                    return ratio_of(x - output(f"mean_{w}"), output(f"std_{w}"))
                case "pct_from_mean":
                    return ratio_of(x, output(f"mean_{w}")) - 1
                case "return":
                    return ratio_of(back(filled, 0), back(filled, w)) - 1
                case "momentum":
                    return ratio_of(x, back(xs, w)) - 1
                case "roc":
                    return ratio_of(x - back(xs, w), back(xs, w))
                case "trend":
                    return slope(w)
                case "volatility":
                    return deviation_of(once("gains", gains), w)
                case "atr":
                    return ratio_of(output(f"max_{w}") - output(f"min_{w}"), output(f"mean_{w}"))
                case "cv":
                    return ratio_of(output(f"std_{w}"), output(f"mean_{w}"))
                case "q25":
                    return once(("quartiles", w), quartiles, w)[0]
                case "q75":
                    return once(("quartiles", w), quartiles, w)[1]
                case "iqr":
                    return output(f"q75_{w}") - output(f"q25_{w}")
                case "above_q75":
                    return x > output(f"q75_{w}")
                case "below_q25":
                    return x < output(f"q25_{w}")
            raise ValueError(f"Unknown indicator: {name}")

        with np.errstate(all="ignore"):
            values = [np.empty((n, width * sum(map(len, group)))) for group in groups]
            for group, into in zip(groups, values):
                begin = 0
                for outputs in group:
                    family = into[:, begin : begin + width * len(outputs)]
                    for i, name in enumerate(outputs):
                        family[:, i :: len(outputs)] = output(name)
                    begin += width * len(outputs)
        return values, (xs[-reach:], ats[-reach:], filled[-reach:])

    return derive


def indicator_rows(
    df: DataFrame,
    r: Roles,
    wanted: IndicatorSet,
    keep: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Indicators in long form, partitioned by ``block``: one row per (row, feature).

    Windows and slopes count rows in the order of ``row_id``. If it has holes (rows were
    filtered out after indexing) or repeats, rows are numbered anew inside and come out with
    the ``row_id`` they had.
    """
    count = dense_rows(df, r.row_id)
    if count is None:
        placed = with_row_id(df, [r.row_id], "_place")
        inner = replace(r, row_id="_place")
        return indicator_rows(placed, inner, wanted, [r.row_id, *keep], block_rows).drop("_place")
    rows = feature_rows(df, r, wanted, keep, block_rows, count)
    order = Window.partitionBy("block", "f").orderBy(r.row_id)
    x = F.col("x")

    def frame(size: int):
        return order.rowsBetween(1 - size, 0)

    base: dict[str, Column] = {}

    def need(*stats: str) -> None:
        for name in stats:
            kind, size = name.rsplit("_", 1)
            size = int(size)
            over = frame(size)
            base.setdefault(f"n_{size}", F.count("x").over(over))
            if kind == "slope":
                base[name] = F.regr_slope(x, F.col("at")).over(over)
            elif kind == "values":
                # Sorting the short frame costs a quarter of what percentile() does per row.
                base[name] = F.collect_list("x").over(over)
            else:
                aggregate = {
                    "avg": F.avg,
                    "sd": F.stddev_samp,
                    "lo": F.min,
                    "hi": F.max,
                }[kind]
                base[name] = aggregate("x").over(over)

    shifts = {*wanted.lags, *wanted.momentum, *wanted.roc}
    for k in shifts:
        base[f"shift_{k}"] = F.lag("x", k).over(order)
    if wanted.needs_returns:
        base["filled"] = (
            F.last("x", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
            if wanted.fill == "pad"
            else x
        )
    for w in wanted.windows:
        kinds = {"mean": ["avg"], "min": ["lo"], "max": ["hi"], "pct_from_mean": ["avg"]}
        kinds |= {"std": ["sd", "lo", "hi"], "zscore": ["avg", "sd", "lo", "hi"]}
        for s in wanted.stats:
            need(*[f"{k}_{w}" for k in kinds[s]])
    for w in wanted.dispersion_windows:
        kinds = {"volatility": [], "atr": ["avg", "lo", "hi"], "cv": ["avg", "sd", "lo", "hi"]}
        for s in wanted.dispersion:
            need(*[f"{k}_{w}" for k in kinds[s]])
    for w in wanted.trend:
        need(f"slope_{w}")
    for w in wanted.quantile_windows:
        need(f"values_{w}")

    stage = rows.select("*", *[c.alias(n) for n, c in base.items()])
    if wanted.quantile_windows:
        stage = _with_quartiles(stage, wanted.quantile_windows)
    if wanted.needs_returns:
        steps = set(wanted.returns)
        if wanted.dispersion_windows and "volatility" in wanted.dispersion:
            steps.add(1)
        stage = stage.select(
            "*",
            *[
                (ratio(F.col("filled"), F.lag("filled", w).over(order)) - 1).alias(f"ret_{w}")
                for w in steps
            ],
        )
    if wanted.dispersion_windows and "volatility" in wanted.dispersion:
        spread = []
        for w in wanted.dispersion_windows:
            over = frame(w)
            moves = F.stddev_samp("ret_1").over(over)
            flat = F.min("ret_1").over(over) == F.max("ret_1").over(over)
            spread.append(
                full_window(
                    F.when(flat, F.lit(0.0)).otherwise(moves), F.count("ret_1").over(over), w
                ).alias(f"moves_{w}")
            )
        stage = stage.select("*", *spread)

    outputs = [_output(n, x).alias(n) for n in wanted.names()]
    return stage.where("own").select("block", r.row_id, *keep, "f", "x", *outputs)


def _with_quartiles(stage: DataFrame, windows: Sequence[int]) -> DataFrame:
    frames = [f"values_{w}" for w in windows]
    ordered = stage.withColumns({c: F.sort_array(c) for c in frames})
    quartiles = {}
    for w, values in zip(windows, frames):
        for i, q in enumerate((0.25, 0.75)):
            at = (w - 1) * q
            low = F.get(values, F.lit(int(at)))
            step = F.get(values, F.lit(min(int(at) + 1, w - 1))) - low
            quartiles[f"quartile{i}_{w}"] = low + step * (at - int(at))
    return ordered.withColumns(quartiles).drop(*frames)


def _output(name: str, x: Column) -> Column:
    kind, size = name.rsplit("_", 1)
    w = int(size)

    def whole(stat: str) -> Column:
        return full_window(F.col(f"{stat}_{w}"), F.col(f"n_{w}"), w)

    def deviation() -> Column:
        # A constant window has a deviation of exactly 0, whatever the rounding.
        flat = F.col(f"lo_{w}") == F.col(f"hi_{w}")
        return full_window(
            F.when(flat, F.lit(0.0)).otherwise(F.col(f"sd_{w}")), F.col(f"n_{w}"), w
        )

    def quartile(i: int) -> Column:
        return whole(f"quartile{i}")

    match kind:
        case "lag":
            return F.col(f"shift_{w}")
        case "mean":
            return whole("avg")
        case "std":
            return deviation()
        case "min":
            return whole("lo")
        case "max":
            return whole("hi")
        case "zscore":
            return ratio(x - whole("avg"), deviation())
        case "pct_from_mean":
            return ratio(x, whole("avg")) - 1
        case "return":
            return F.col(f"ret_{w}")
        case "momentum":
            return ratio(x, F.col(f"shift_{w}")) - 1
        case "roc":
            return ratio(x - F.col(f"shift_{w}"), F.col(f"shift_{w}"))
        case "trend":
            return whole("slope")
        case "volatility":
            return F.col(f"moves_{w}")
        case "atr":
            return ratio(whole("hi") - whole("lo"), whole("avg"))
        case "cv":
            return ratio(deviation(), whole("avg"))
        case "q25":
            return quartile(0)
        case "q75":
            return quartile(1)
        case "iqr":
            return quartile(1) - quartile(0)
        case "above_q75":
            return F.coalesce(x > quartile(1), F.lit(False)).cast("int")
        case "below_q25":
            return F.coalesce(x < quartile(0), F.lit(False)).cast("int")
    raise ValueError(f"Unknown indicator: {name}")


def _long(df: DataFrame, r: Roles, wanted: IndicatorSet, block_rows: int | None) -> DataFrame:
    names = F.array(*[F.lit(c) for c in feature_columns(df, r.features)])
    return indicator_rows(df, r, wanted, block_rows=block_rows).select(
        r.row_id, names[F.col("f")].alias("feature"), *wanted.names()
    )


def lag_features(df, r: Roles, lags=LAGS, block_rows=None) -> DataFrame:
    """``lag_k``: the value k rows earlier. One row per (row, feature), as all below."""
    return _long(df, r, IndicatorSet(lags=lags), block_rows)


def rolling_stats(df, r: Roles, windows=LOOKBACKS, stats=ROLLING, block_rows=None) -> DataFrame:
    """Rolling mean, deviation, minimum, maximum, z-score and distance from the mean."""
    return _long(df, r, IndicatorSet(windows=windows, stats=stats), block_rows)


def momentum(
    df, r: Roles, returns=RETURNS, windows=LOOKBACKS, roc=ROC, trend=TREND, fill="pad", block_rows=None
) -> DataFrame:
    """Returns on gap-filled values, momentum, rate of change and least-squares slope."""
    wanted = IndicatorSet(returns=returns, momentum=windows, roc=roc, trend=trend, fill=fill)
    return _long(df, r, wanted, block_rows)


def volatility(
    df, r: Roles, windows=LOOKBACKS, measures=DISPERSION, fill="pad", block_rows=None
) -> DataFrame:
    """Deviation of one-step returns, range over mean, deviation over mean."""
    wanted = IndicatorSet(dispersion_windows=windows, dispersion=measures, fill=fill)
    return _long(df, r, wanted, block_rows)


def rolling_quantiles(
    df, r: Roles, windows=QUANTILE_WINDOWS, outputs=QUANTILES, block_rows=None
) -> DataFrame:
    """Rolling quartiles, their distance, and flags for values outside them."""
    return _long(df, r, IndicatorSet(quantile_windows=windows, quantiles=outputs), block_rows)


def wide_columns(rows: DataFrame, r: Roles, names: Sequence[str], wanted: IndicatorSet, keep=()) -> DataFrame:
    """Long indicators back to one row per ``row_id`` with columns ``{feature}_{output}``.

    ``rows`` comes from ``indicator_rows``; rows of one ``row_id`` share its block, so no
    shuffle is added.
    """
    outputs = wanted.names()
    packed = rows.groupBy("block", r.row_id, *keep).agg(
        F.array_sort(F.collect_list(F.struct("f", *outputs))).alias("cells")
    )
    return packed.select(
        r.row_id,
        *keep,
        *[F.col("cells")[i][o].alias(f"{n}_{o}") for o in outputs for i, n in enumerate(names)],
    )
