"""A whole flow in one call: a rolling z-score strategy measured on purged folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.cleaning import drop_zero_weight
from quantloom.operators.indicators import IndicatorSet, indicator_rows
from quantloom.operators.ordering import with_row_id
from quantloom.operators.splits import assign, purged_folds
from quantloom.operators.utility import utility
from quantloom.roles import Roles


def zscore_strategy(
    df: DataFrame,
    r: Roles,
    order_by: Sequence[str],
    feature: str = "feature_0",
    window: int = 20,
    n: int = 5,
    gap: int = 1,
    block_rows: int | None = None,
) -> DataFrame:
    """Utility per fold when the z-score of ``feature`` is the score.

    Only the used columns reach the scan, and zero weights are filtered there.
    """
    used = df.select(*dict.fromkeys([*order_by, r.date, r.weight, r.target, feature]))
    kept = with_row_id(drop_zero_weight(used, r), order_by, r.row_id)
    one = Roles((feature,), r.target, r.weight, r.date, r.row_id)
    wanted = IndicatorSet(windows=(window,), stats=("zscore",))
    keys = [r.date, r.weight, r.target]
    scored = indicator_rows(kept, one, wanted, keys, block_rows).select(
        r.row_id, *keys, F.col(f"zscore_{window}").alias("pred")
    )
    tested = assign(scored, purged_folds(kept, r.date, n, gap=gap), ("test",))
    return utility(tested, "pred", r, ["fold"])
