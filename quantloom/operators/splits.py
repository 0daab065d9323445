"""Time-aware and stratified train/test splits.

A split is a list of ``Fold`` conditions over the rows. A training job filters with them, a
report explodes them; neither joins or shuffles the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.joins import null_safe_join
from quantloom.operators.ordering import SMALL_ROWS, dense_rows, small_or_indexed, with_row_id
from quantloom.roles import Roles

STRATEGIES = ("purged_group_ts", "time_series", "stratified")


@dataclass(frozen=True)
class Fold:
    number: int
    train: Column
    test: Column


def chunk_bounds(total: int, chunks: int) -> list[int]:
    """Start positions of near-equal chunks (the first ones are one longer), then the end."""
    size, longer = divmod(total, chunks)
    return [i * size + min(i, longer) for i in range(chunks + 1)]


def purged_folds(
    df: DataFrame, group: str, n: int = 5, max_train: int | None = None, gap: int = 0
) -> list[Fold]:
    """Train on the groups before each test chunk, without those within ``gap`` of it.

    ``max_train`` keeps the latest groups only and applies before the gap; 0 means no limit. Only the group
    values at chunk borders, at most ``3 n`` of them, reach the driver.
    """
    if group not in df.columns:
        raise ValueError(f"Group column '{group}' not found in data")
    keys, total = small_or_indexed(df, group, "position")
    if total < n + 1:
        raise ValueError(f"Not enough groups ({total}) for {n} splits")
    bounds = chunk_bounds(total, n + 1)
    firsts = [max(0, bounds[i + 1] - max_train) if max_train else 0 for i in range(n)]
    wanted = {*bounds[:-1], *firsts, *[b - 1 for b in bounds[2:]]}
    value = {
        row["position"]: row[group]
        for row in keys.where(F.col("position").isin(sorted(wanted))).collect()
    }
    folds: list[Fold] = []
    g = F.col(group)
    for i in range(n):
        start, end = value[bounds[i + 1]], value[bounds[i + 2] - 1]
        limit = start - gap if gap > 0 else start
        if not value[firsts[i]] < limit:
            continue  # nothing left to train on
        folds.append(
            Fold(len(folds), (g >= value[firsts[i]]) & (g < limit), (g >= start) & (g <= end))
        )
    return folds


def time_series_folds(df: DataFrame, row_id: str, n: int = 5) -> list[Fold]:
    """Expanding window over the row order given by the unique ``row_id``.

    Folds count rows: where ``row_id`` has holes, rows are numbered anew and only the at
    most ``2 n`` border values reach the driver.
    """
    dense = dense_rows(df, row_id)
    rows = df.count() if dense is None else dense
    size = rows // (n + 1)
    if size == 0:
        raise ValueError(f"Not enough rows ({rows}) for {n} splits")
    at = F.col(row_id)
    starts = [rows - (n - i) * size for i in range(n)]
    if dense is not None:
        return [
            Fold(i, at < start, (at >= start) & (at < start + size)) for i, start in enumerate(starts)
        ]
    borders = sorted({*starts, *[start + size - 1 for start in starts]})
    placed = with_row_id(df.select(row_id), [row_id], "_place").where(F.col("_place").isin(borders))
    value = {p["_place"]: p[row_id] for p in placed.collect()}
    return [
        Fold(i, at < value[start], (at >= value[start]) & (at <= value[start + size - 1]))
        for i, start in enumerate(starts)
    ]


def _shuffled_rank(df: DataFrame, y: str, key: str, seed: int) -> DataFrame:
    """Position of each row inside its class in a seeded random order: adds ``_rank, _size``."""
    mixed = df.withColumn("_mix", F.md5(F.concat_ws(":", F.col(key), F.lit(seed))))
    placed = with_row_id(mixed, [y, "_mix", key], "_at").drop("_mix")
    classes = placed.groupBy(y).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    if classes.count() <= SMALL_ROWS:
        classes = F.broadcast(classes)  # a class may hold most rows: do not shuffle by it
    # A missing label is a class of its own, so that no row is lost.
    return null_safe_join(placed, classes, [y]).withColumn("_rank", F.col("_at") - F.col("_first"))


def with_stratified_fold(
    df: DataFrame, y: str, n: int, seed: int, key: str = "row_id", exact: bool = True
) -> DataFrame:
    """Add ``fold`` so that every fold holds its share of every class.

    ``exact`` deals the rows of a class round robin (one range shuffle). Otherwise the fold
    is a hash of the key: no shuffle, shares are right up to sampling noise.
    """
    if exact:
        ranked = _shuffled_rank(df, y, key, seed)
        return ranked.select(*df.columns, (F.col("_rank") % n).cast("int").alias("fold"))
    mix = F.md5(F.concat_ws(":", F.col(key), F.lit(seed)))
    bits = F.conv(F.substring(mix, 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (bits % n).cast("int"))


def stratified_folds(n: int) -> list[Fold]:
    """Conditions over the ``fold`` column of ``with_stratified_fold``."""
    return [Fold(i, F.col("fold") != i, F.col("fold") == i) for i in range(n)]


def holdout(
    df: DataFrame, y: str, fraction: float = 0.2, seed: int = 42, key: str = "row_id"
) -> DataFrame:
    """Add the flag ``is_validation`` for a stratified share of the rows."""
    ranked = _shuffled_rank(df, y, key, seed)
    cut = F.floor(F.col("_size") * F.lit(fraction) + 0.5)
    return ranked.select(*df.columns, (F.col("_rank") < cut).alias("is_validation"))


def make_folds(
    df: DataFrame,
    r: Roles,
    strategy: str = "purged_group_ts",
    n: int = 5,
    gap: int = 0,
    seed: int = 42,
    y: str = "y",
) -> tuple[DataFrame, list[Fold]]:
    """Folds by strategy name; the table is returned as stratified folds add a column."""
    if strategy == "purged_group_ts":
        return df, purged_folds(df, r.date, n, gap=gap)
    if strategy == "time_series":
        return df, time_series_folds(df, r.row_id, n)
    if strategy == "stratified":
        return with_stratified_fold(df, y, n, seed, r.row_id), stratified_folds(n)
    raise ValueError(f"Unknown CV strategy: {strategy}")


def assign(df: DataFrame, folds: Sequence[Fold], roles: Sequence[str] = ("train", "test")) -> DataFrame:
    """One row per (fold, role) a row belongs to; rows in no fold drop out."""
    places = []
    for fold in folds:
        for role in roles:
            place = F.struct(F.lit(fold.number).alias("fold"), F.lit(role).alias("role"))
            places.append(F.when(getattr(fold, role), place))
    columns = [c for c in df.columns if c != "fold"]
    if not places:
        return df.where(F.lit(False)).select(F.lit(0).alias("fold"), F.lit("").alias("role"), *columns)
    placed = df.select(*columns, F.explode(F.array_compact(F.array(*places))).alias("_place"))
    return placed.select("_place.fold", "_place.role", *columns)


def splits(df: DataFrame, r: Roles, strategy: str = "purged_group_ts", n: int = 5, gap: int = 0, seed: int = 42, y: str = "y") -> DataFrame:
    """``(fold, role, *columns)`` for the named strategy."""
    table, folds = make_folds(df, r, strategy, n, gap, seed, y)
    return assign(table, folds)


def purged_splits(df: DataFrame, group: str, n: int = 5, max_train: int | None = None, gap: int = 0) -> DataFrame:
    """``(fold, role, *columns)`` of the purged group split."""
    return assign(df, purged_folds(df, group, n, max_train, gap))
