"""The flagship flow."""

from __future__ import annotations

from checks.evaluation import FOLDS_SQL
from checks.timeseries import std, whole
from checks.views import RAW_TICKS_SQL, raw_ticks, round_sql, rounded
from quantloom import Roles
from quantloom.plans.strategy import zscore_strategy


def strategy(spark, sf):
    return rounded(zscore_strategy(raw_ticks(spark, sf), Roles(), ["ts", "event_id"]))


QUERIES = {"zscore_strategy": strategy}

SQL = {
    "zscore_strategy": f"""WITH {RAW_TICKS_SQL}, ticks AS (
        SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, * FROM raw_ticks
        WHERE weight IS NULL OR weight <> 0), {FOLDS_SQL},
      cells AS (SELECT row_id, 'f' AS feature, feature_0 AS x FROM ticks),
      scored AS (SELECT row_id, (x - ({whole('avg(x)', 20)})) / nullif({std(20)}, 0) AS z FROM cells),
      out AS (SELECT fold, sum(resp * weight * coalesce(z >= 0.5e0, false)::INTEGER) AS utility
        FROM members JOIN ticks USING (date) JOIN scored USING (row_id) WHERE role = 'test' GROUP BY fold) """
    + round_sql("out", ["fold"], ["utility"])
}
