"""Global row order without a single-partition sort.

``with_row_id`` numbers rows in key order; ``with_halo`` cuts the numbered table in
blocks that can be windowed independently; ``carried_values`` supplies what a block
needs from an unbounded distance. ``running_total`` is a distributed prefix sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import elements
from quantloom.functions.joins import null_safe_join
from quantloom.session import materialise

_POS_BITS = 33  # low bits of monotonically_increasing_id count rows inside a partition
MAX_BLOCK_ROWS = 131_072
SMALL_ROWS = 100_000


def range_runs(df: DataFrame, order_by: Sequence[str], label: str) -> DataFrame:
    """Store ``df`` in range partitions of ``order_by``; adds ``_part`` and ``_pos``.

    All rows of part i sort before those of part i+1 and ``_pos`` counts from 0 inside
    a part. Range bounds are sampled anew in every job, so the layout is stored before
    anything is derived from it. ``order_by`` must be unique or nearly so: equal keys
    share a part.
    """
    # Without a number AQE may merge small neighbouring ranges, which keeps their order.
    stored = materialise(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_run", F.monotonically_increasing_id()),
        label,
    )
    return stored.select(
        *df.columns,
        F.shiftright("_run", _POS_BITS).cast("int").alias("_part"),
        F.col("_run").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"),
    )


def _before(per_part: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sum over parts; ``per_part`` has one row per part (and group)."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        *by, "_part", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("_before")
    )


def with_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense 0-based index in the order of ``order_by`` (must be unique)."""
    runs = range_runs(df, order_by, "ordered")
    sizes = runs.groupBy("_part").agg((F.max("_pos") + 1).alias("_rows"))
    # One row per range partition, so never more than spark.sql.shuffle.partitions.
    starts = F.broadcast(_before(sizes, "_rows"))
    return runs.join(starts, "_part").select(
        (F.col("_before") + F.col("_pos")).alias(name), *df.columns
    )


def _multiset(value) -> list:
    """Sums of two independent 64-bit hashes of the values, in 32-bit halves, as decimals."""
    at = value.cast("bigint")
    mask = F.lit(0xFFFFFFFF)
    found = []
    for h in (F.xxhash64(at), F.xxhash64(at, F.lit("second"))):
        for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(mask)):
            found.append(F.sum(half.cast("decimal(38,0)")))
    return found


def dense_rows(df: DataFrame, row_id: str) -> int | None:
    """Number of rows if ``row_id`` counts them from 0 without holes or repeats, else None.

    The ids must lie in [0, n - 1] and, as a multiset, equal 0 .. n - 1: sums of two
    independent 64-bit hashes of the ids are compared with those of ``range(n)``, so a
    repeat that fills a hole passes with a chance of about 2^-128. Two aggregates, no shuffle.
    A filter after indexing leaves holes; positions must then be numbered anew.
    """
    seen = df.agg(F.count("*"), F.count(row_id), F.min(row_id), F.max(row_id), *_multiset(F.col(row_id))).first()
    n = seen[0]
    if n == 0:
        return 0
    if seen[1] != n or (seen[2], seen[3]) != (0, n - 1):
        return None
    wanted = df.sparkSession.range(n).agg(*_multiset(F.col("id"))).first()
    return n if tuple(seen[4:]) == tuple(wanted) else None


def running_total(
    df: DataFrame, by: Sequence[str], order_by: str, value: str, name: str
) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order_by`` order, within each ``by`` group.

    A group may be far larger than a task: each range partition is summed on its own
    and shifted by the total of the partitions before it. ``(by, order_by)`` must be unique.
    """
    runs = range_runs(df, [*by, order_by], "running")
    # At most one row per range partition plus one per group boundary.
    starts = _before(runs.groupBy(*by, "_part").agg(F.sum(value).alias("_subtotal")), "_subtotal", by)
    inside = (
        Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = runs.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return null_safe_join(local, starts, [*by, "_part"]).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(name)
    )


def block_rows_for(rows: int, look_back: int, tasks: int) -> int:
    """Rows per block: a few blocks per task, yet long against the copied look-back rows."""
    return max(4 * max(look_back, 1), min(MAX_BLOCK_ROWS, rows // (4 * tasks) + 1), 256)


def with_halo(df: DataFrame, row_id: str, look_back: int, block_rows: int) -> DataFrame:
    """Assign rows to blocks and copy each block's last ``look_back`` rows to the next one.

    Adds ``block`` and ``own`` (false on the copies). A window over ``block`` then sees
    the same frame as a window over the whole table.
    """
    if look_back > block_rows:
        raise ValueError("look_back must not exceed block_rows")
    home = F.expr(f"{row_id} div {block_rows}")
    in_tail = F.col(row_id) % block_rows >= block_rows - look_back
    target = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    return df.select("*", F.explode(target).alias("block")).withColumn(
        "own", F.col("block") == home
    )


def carried_values(df: DataFrame, row_id: str, xs: str, look_back: int, block_rows: int) -> DataFrame:
    """Last non-null value of every feature before each block's halo: ``(block, xs)``.

    Forward fill reaches back without limit. The last values per block are reduced in
    two levels (blocks inside a group of blocks, then the groups), so no task holds
    more than about the square root of the number of blocks per feature.
    """
    segment = F.expr(f"({row_id} + {look_back}) div {block_rows}")
    lasts = materialise(
        df.select(F.col(row_id), segment.alias("segment"), elements(xs))
        .groupBy("segment", "f")
        .agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col(row_id))).alias("x")),
        "carry",
    )
    segments = (lasts.agg(F.max("segment")).first()[0] or 0) + 1
    lasts = lasts.withColumn("bundle", F.expr(f"segment div {max(1, int(segments**0.5))}"))

    def running_last(value: str, by: list[str], order: str) -> Column:
        earlier = (
            Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.last(value, ignorenulls=True).over(earlier)

    bundles = (
        lasts.groupBy("f", "bundle")
        .agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col("segment"))).alias("x"))
        .select("f", "bundle", running_last("x", ["f"], "bundle").alias("far"))
    )
    return (
        lasts.withColumn("near", running_last("x", ["f", "bundle"], "segment"))
        .join(bundles, ["f", "bundle"])
        .where("segment > 0")
        .withColumn("x", F.coalesce("near", "far"))
        .groupBy(F.col("segment").alias("block"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("f", "x"))), lambda pair: pair["x"]
            ).alias(xs)
        )
    )


def small_or_indexed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """Index distinct keys: one window for a short list, the distributed index otherwise."""
    keys = materialise(df.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    n = keys.count()
    if n <= SMALL_ROWS:
        return keys.withColumn(name, F.row_number().over(Window.orderBy(key)) - 1), n
    return with_row_id(keys, [key], name), n

