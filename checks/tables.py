"""Sources, cleaning, cross-section, interactions and the joined feature set."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from urllib.parse import urlparse

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from checks.timeseries import FILLED, lag, std, whole
from checks.views import (
    CELLS_SQL,
    RAW_TICKS_SQL,
    TICK_FEATURES,
    TICKS_SQL,
    WIDE_CELLS_SQL,
    WIDE_SQL,
    WIDTH,
    raw_ticks,
    round_sql,
    rounded,
    ticks,
    wide,
)
from quantloom import Roles, feature_columns
from quantloom.operators import cleaning as cl
from quantloom.operators.crosssection import CROSS_SECTION, cross_section, interactions
from quantloom.operators.featureset import all_features, feature_summary, feature_values
from quantloom.operators.indicators import IndicatorSet
from quantloom.plans.loading import load_processed
from quantloom.session import checkpoint_root
from quantloom.sources import read_table

R = Roles(n_features=3)
WIDE = Roles(n_features=WIDTH)
TICK_COLUMNS = "event_id, ts, date, feature_0, feature_1, feature_2, weight, resp, pred, pred_b"


def _scratch(spark, label: str) -> str:
    return f"{checkpoint_root(spark)}/checks/{label}-{uuid.uuid4().hex}"


def _csv(spark, sf_dir) -> str:
    path = _scratch(spark, "ticks") + ".csv"
    writer = raw_ticks(spark, sf_dir).write.option("header", True)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return path


def scan_csv(spark, sf_dir):
    schema = raw_ticks(spark, sf_dir).schema
    return read_table(spark, _csv(spark, sf_dir), schema)


def scan_zip_csv(spark, sf_dir):
    """Every partition of the ticks becomes one archive; all archives are read back.

    A partition without rows is a header alone. An archive gets its partition's name when it is
    whole, so a task that runs twice leaves it once.
    """
    source = raw_ticks(spark, sf_dir)
    folder = _scratch(spark, "zips")
    names = source.columns
    # pandas would hold whole numbers with a gap as floats, 3 as 3.0.
    texts = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f.name) for f in source.schema]

    def pack(batches):
        import pandas as pd

        here = urlparse(folder).path if folder.startswith("file:") else folder
        os.makedirs(here, exist_ok=True)
        path, rows = f"{here}/{uuid.uuid4().hex}.part", 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open("train.csv", "w", force_zip64=True) as member:
                text = io.TextIOWrapper(member)
                pd.DataFrame(columns=names).to_csv(text, index=False)
                for batch in batches:
                    batch.to_csv(text, index=False, header=False, columns=names)
                    rows += len(batch)
                text.flush()
        os.replace(path, f"{here}/{TaskContext.get().partitionId()}.zip")
        yield pd.DataFrame({"rows": [rows]})

    source.select(*texts).mapInPandas(pack, "rows long").agg(F.sum("rows")).collect()
    return read_table(spark, f"{folder}/*.zip", source.schema)


def missing(spark, sf_dir):
    return cl.missing_counts(ticks(spark, sf_dir).select("date", "weight", "resp", *TICK_FEATURES))


def filled(spark, sf_dir):
    kept = cl.drop_zero_weight(ticks(spark, sf_dir), R)
    return rounded(cl.fill_mean(kept, list(TICK_FEATURES)).select("row_id", *TICK_FEATURES, "weight"))


def non_finite(spark, sf_dir):
    """Ratios with plain division by zero: NaN and infinities, then cleaned."""
    t = ticks(spark, sf_dir)
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    zero = F.col("feature_1") == 0
    bad = F.when(zero & (F.col("resp") == 0), nan).when(zero, inf * F.signum("resp"))
    made = t.select("row_id", bad.alias("bad"), F.coalesce(bad, F.col("feature_1")).alias("mixed"))
    return rounded(cl.non_finite_to_null(made))


def processed(spark, sf_dir):
    table, _ = load_processed(ticks(spark, sf_dir), R, downcast=False)
    return rounded(table)


def processed_metadata(spark, sf_dir):
    _, meta = load_processed(ticks(spark, sf_dir), R, downcast=False)
    return rounded(meta)


PART = IndicatorSet(lags=(1,), windows=(5,), returns=(1,), momentum=(), trend=(10,), dispersion_windows=(5,))


def feature_set(spark, sf_dir):
    """All families at small settings, one row per derived value."""
    made = all_features(ticks(spark, sf_dir), R, PART, limit=4)
    return rounded(feature_values(made, ["row_id"]))


FAMILIES = {
    "cross_sectional": "^(rank_|n_|feature_(mean|std|median|skew|kurt)$)",
    "interaction": "_(mult|div)$",
    "lag": "_lag_[0-9]+$",
    "momentum": "_(return|momentum|roc|trend)_[0-9]+$",
    "rolling": "_(mean|std|min|max|zscore|pct_from_mean)_[0-9]+$",
    "volatility": "_(volatility|atr|cv)_[0-9]+$",
    "original": "^feature_[0-9]+$",
}


def family_counts(spark, sf_dir):
    """Columns per family by the summary, with the values the families hold over all rows."""
    table = ticks(spark, sf_dir)
    made = feature_values(all_features(table, R, PART, limit=4), ["row_id"])
    family = F.coalesce(*[F.when(F.col("feature").rlike(p), n) for n, p in FAMILIES.items()])
    present = made.groupBy(family.alias("family")).agg(F.count("value").alias("present"))
    return feature_summary(table, R, PART, limit=4).join(present, "family")


def _feature_set_sql() -> str:
    per_feature = {
        "lag_1": lag(1),
        "mean_5": whole("avg(x)", 5),
        "std_5": std(5),
        "min_5": whole("min(x)", 5),
        "max_5": whole("max(x)", 5),
        "zscore_5": f"(x - ({whole('avg(x)', 5)})) / nullif({std(5)}, 0)",
        "pct_from_mean_5": f"x / nullif({whole('avg(x)', 5)}, 0) - 1",
        "return_1": "ret",
        "trend_10": whole("regr_slope(x, row_id)", 10),
        "volatility_5": std(5, "ret"),
        "atr_5": f"({whole('max(x)', 5)} - ({whole('min(x)', 5)})) / nullif({whole('avg(x)', 5)}, 0)",
        "cv_5": f"({std(5)}) / nullif({whole('avg(x)', 5)}, 0)",
    }
    wide_part = ", ".join(f"{sql} AS {n}" for n, sql in per_feature.items())
    union = ["SELECT row_id, feature, x AS value FROM cells"]
    union += [
        f"SELECT row_id, feature || '_{n}' AS feature, {n} AS value FROM per_feature" for n in per_feature
    ]
    union += [f"SELECT row_id, '{c}' AS feature, {c}::DOUBLE AS value FROM crossed" for c in CROSS_SECTION]
    pairs = [
        ("feature_0_feature_1_mult", "feature_0 * feature_1"),
        ("feature_0_feature_1_div", "feature_0 / nullif(feature_1, 0)"),
        ("feature_0_feature_2_mult", "feature_0 * feature_2"),
        ("feature_0_feature_2_div", "feature_0 / nullif(feature_2, 0)"),
    ]
    union += [f"SELECT row_id, '{n}' AS feature, {sql} AS value FROM ticks" for n, sql in pairs]
    return (
        f"{CELLS_SQL}{FILLED}, per_feature AS (SELECT row_id, feature, {wide_part} FROM moves), "
        f"{cross_sql('cells')}, every AS ({' UNION ALL '.join(union)}) "
    )


def cross_sql(source: str) -> str:
    """Cross-section of (row_id, x) rows as the CTE ``crossed``."""
    return f"""known AS (SELECT row_id, x FROM {source} WHERE x IS NOT NULL),
ranked AS (SELECT row_id, x,
  (rank() OVER (PARTITION BY row_id ORDER BY x) + (count(*) OVER (PARTITION BY row_id, x) - 1) / 2.0e0)
    / count(*) OVER (PARTITION BY row_id) AS pct,
  quantile_cont(x, 0.95) OVER (PARTITION BY row_id) AS q95,
  quantile_cont(x, 0.05) OVER (PARTITION BY row_id) AS q05 FROM known),
crossed AS (SELECT row_id, avg(pct) AS rank_mean, stddev_samp(pct) AS rank_std,
  avg(x) AS feature_mean, stddev_samp(x) AS feature_std, median(x) AS feature_median,
  CASE WHEN count(*) >= 3 THEN CASE WHEN min(x) = max(x) THEN 0e0 ELSE skewness(x) END END AS feature_skew,
  CASE WHEN count(*) >= 4 THEN CASE WHEN min(x) = max(x) THEN 0e0 ELSE kurtosis(x) END END AS feature_kurt,
  count_if(x > 0)::INTEGER AS n_positive, count_if(x < 0)::INTEGER AS n_negative,
  count_if(x > q95)::INTEGER AS n_extreme_positive, count_if(x < q05)::INTEGER AS n_extreme_negative
  FROM ranked GROUP BY row_id)"""


def pairs_sql(names: list[str], first: int = 10, limit: int = 50) -> dict[str, str]:
    out = {}
    for i, a in enumerate(names[:first]):
        for b in names[i + 1 : first]:
            out[f"{a}_{b}_mult"] = f"{a} * {b}"
            out[f"{a}_{b}_div"] = f"{a} / nullif({b}, 0)"
    return dict(list(out.items())[:limit])


CROSS_DOUBLES = [c for c in CROSS_SECTION if not c.startswith("n_")]
CROSS_COUNTS = [c for c in CROSS_SECTION if c.startswith("n_")]
PAIRS = pairs_sql([f"feature_{i}" for i in range(WIDTH)])
FILL_COLUMNS = ", ".join(f"coalesce({f}, avg({f}) OVER ()) AS {f}" for f in TICK_FEATURES)

QUERIES = {
    "scan_csv": lambda spark, sf: rounded(scan_csv(spark, sf)),
    "scan_zip_csv": lambda spark, sf: rounded(scan_zip_csv(spark, sf)),
    "scan_parquet": lambda spark, sf: read_table(spark, f"{sf}/orders.parquet"),
    "feature_projection": lambda spark, sf: rounded(
        raw_ticks(spark, sf).select("event_id", *feature_columns(raw_ticks(spark, sf), "feature_"))
    ),
    "validate_structure": lambda spark, sf: cl.validate_structure(raw_ticks(spark, sf), R),
    "downcast_floats": lambda spark, sf: cl.downcast_floats(
        raw_ticks(spark, sf).select("event_id", *TICK_FEATURES)
    ).select("event_id", *[F.round(F.col(f).cast("double"), 4).alias(f) for f in TICK_FEATURES]),
    "drop_zero_weight": lambda spark, sf: cl.drop_zero_weight(raw_ticks(spark, sf), R).select(
        "event_id", "weight"
    ),
    "fill_mean": filled,
    "missing_counts": missing,
    "binary_target": lambda spark, sf: cl.with_target(raw_ticks(spark, sf), R).select("event_id", "y"),
    "features_and_target": lambda spark, sf: rounded(
        cl.features_and_target(ticks(spark, sf), R)
    ),
    "load_processed": processed,
    "load_metadata": processed_metadata,
    "non_finite_to_null": non_finite,
    "cross_section": lambda spark, sf: rounded(cross_section(wide(spark, sf), WIDE)),
    "cross_section_with_gaps": lambda spark, sf: rounded(cross_section(ticks(spark, sf), R)),
    "interactions": lambda spark, sf: rounded(interactions(wide(spark, sf), WIDE)),
    "all_features": feature_set,
    "feature_summary": family_counts,
}

SQL = {
    "scan_csv": f"WITH {RAW_TICKS_SQL} "
    + round_sql(
        "raw_ticks", ["event_id", "ts", "date"], [*TICK_FEATURES, "weight", "resp", "pred", "pred_b"]
    ),
    "scan_parquet": "SELECT * FROM orders",
    "feature_projection": f"WITH {RAW_TICKS_SQL} "
    + round_sql("raw_ticks", ["event_id"], list(TICK_FEATURES)),
    "validate_structure": f"""WITH {RAW_TICKS_SQL} SELECT count(*) AS total_rows, 10 AS total_columns,
      3 AS feature_count, 3 AS expected_features, true AS features_match, true AS has_target,
      true AS has_weight, true AS has_date, min(date) AS date_min, max(date) AS date_max,
      count(DISTINCT date) AS trading_days FROM raw_ticks""",
    "downcast_floats": f"WITH {RAW_TICKS_SQL} SELECT event_id, "
    + ", ".join(f"round({f}::FLOAT::DOUBLE, 4) AS {f}" for f in TICK_FEATURES)
    + " FROM raw_ticks",
    "drop_zero_weight": f"""WITH {RAW_TICKS_SQL} SELECT event_id, weight FROM raw_ticks
      WHERE weight IS NULL OR weight <> 0""",
    "fill_mean": f"""WITH {TICKS_SQL}, kept AS (SELECT * FROM ticks WHERE weight IS NULL OR weight <> 0),
      out AS (SELECT row_id, weight, {FILL_COLUMNS} FROM kept) """
    + round_sql("out", ["row_id"], [*TICK_FEATURES, "weight"]),
    "missing_counts": f"WITH {TICKS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM ticks"
        for c in ("date", "weight", "resp", *TICK_FEATURES)
    ),
    "binary_target": f"""WITH {RAW_TICKS_SQL} SELECT event_id, coalesce(resp > 0, false)::INTEGER AS y
      FROM raw_ticks""",
    "features_and_target": f"WITH {TICKS_SQL}, out AS (SELECT *, coalesce(resp > 0, false)::INTEGER AS y "
    "FROM ticks) " + round_sql("out", ["row_id", "date", "y"], ["weight", "resp", *TICK_FEATURES]),
    "load_processed": f"""WITH {TICKS_SQL}, kept AS (SELECT * FROM ticks WHERE weight IS NULL OR weight <> 0),
      out AS (SELECT row_id, date, weight, resp, (resp > 0)::INTEGER AS y, {FILL_COLUMNS} FROM kept) """
    + round_sql("out", ["row_id", "date", "y"], ["weight", "resp", *TICK_FEATURES]),
    "load_metadata": f"""WITH {TICKS_SQL}, kept AS (SELECT * FROM ticks WHERE weight IS NULL OR weight <> 0)
      SELECT count(*) AS n_rows, 11 AS n_columns, 3 AS n_features,
      round(avg((resp > 0)::INTEGER), 6) AS positive_rate, true AS has_weights FROM kept""",
    "non_finite_to_null": f"""WITH {TICKS_SQL} SELECT row_id, NULL::DOUBLE AS bad,
      round(CASE WHEN feature_1 <> 0 THEN feature_1 END, 6) AS mixed FROM ticks""",
    "cross_section": f"WITH {WIDE_CELLS_SQL}, {cross_sql('wide_cells')} "
    + round_sql("crossed", ["row_id", *CROSS_COUNTS], CROSS_DOUBLES),
    "cross_section_with_gaps": f"WITH {CELLS_SQL}, {cross_sql('cells')} "
    + round_sql("crossed", ["row_id", *CROSS_COUNTS], CROSS_DOUBLES),
    "interactions": f"WITH {WIDE_SQL}, out AS (SELECT row_id, "
    + ", ".join(f"{sql} AS {n}" for n, sql in PAIRS.items())
    + " FROM wide) "
    + round_sql("out", ["row_id"], list(PAIRS)),
    "all_features": f"WITH {_feature_set_sql()}" + round_sql("every", ["row_id", "feature"], ["value"]),
    "feature_summary": f"WITH {_feature_set_sql()} SELECT CASE "
    + " ".join(f"WHEN regexp_matches(feature, '{p}') THEN '{n}'" for n, p in FAMILIES.items())
    + " END AS family, count(DISTINCT feature) AS columns, count(value) AS present FROM every GROUP BY family",
}
SQL["scan_zip_csv"] = SQL["scan_csv"]
