"""Views of the given tables that play the role of the market table, in Spark and in SQL.

The tables hold no gaps in the used columns, so missing values, zeros and negatives come
from integer arithmetic that both engines evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.ordering import with_row_id

TICK_FEATURES = ("feature_0", "feature_1", "feature_2")
WIDTH = 64


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        "ts",
        "datediff(ts, date'2024-01-01') AS date",
        "value AS feature_0",
        "CASE WHEN event_id % 13 <> 0 THEN value * (event_id % 7 - 3) END AS feature_1",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS feature_2",
        "CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0e0 "
        "ELSE 1e0 + 0.5e0 * (event_id % 5) END AS weight",
        "((event_id * 7919) % 201 - 100) / 1000.0e0 AS resp",
        "((event_id * 104729) % 9973) / 9973.0e0 AS pred",
        "((event_id * 15485863) % 9967) / 9967.0e0 AS pred_b",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ticks with the dense ``row_id`` in order of ``ts, event_id``."""
    return with_row_id(raw_ticks(spark, sf_dir), ["ts", "event_id"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return emb.select(
        F.col("vec_id").alias("row_id"),
        F.expr("vec_id div 10").alias("date"),
        F.expr("CAST(label > 4 AS INT)").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"feature_{i}") for i in range(WIDTH)],
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "datediff(l_shipdate, date'1995-01-01') AS date",
        "l_quantity AS weight",
        "l_discount - l_tax AS resp",
        "((l_orderkey * 104729 + l_partkey) % 9973) / 9973.0e0 AS pred",
        "CAST((l_orderkey + l_linenumber) % 3 = 0 AS INT) AS y",
    )


RAW_TICKS_SQL = """raw_ticks AS (
  SELECT event_id, ts, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS date,
    value AS feature_0,
    CASE WHEN event_id % 13 <> 0 THEN value * (event_id % 7 - 3) END AS feature_1,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS feature_2,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0e0
      ELSE 1e0 + 0.5e0 * (event_id % 5) END AS weight,
    ((event_id * 7919) % 201 - 100) / 1000.0e0 AS resp,
    ((event_id * 104729) % 9973) / 9973.0e0 AS pred,
    ((event_id * 15485863) % 9967) / 9967.0e0 AS pred_b
  FROM events)"""

TICKS_SQL = (
    RAW_TICKS_SQL
    + """, ticks AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, * FROM raw_ticks)"""
)

CELLS_SQL = (
    TICKS_SQL
    + ", cells AS ("
    + " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS feature, {f} AS x FROM ticks" for f in TICK_FEATURES
    )
    + ")"
)

WIDE_SQL = (
    "wide AS (SELECT vec_id AS row_id, vec_id // 10 AS date, (label > 4)::INTEGER AS y, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS feature_{i}" for i in range(WIDTH))
    + " FROM embeddings)"
)

WIDE_CELLS_SQL = """wide_cells AS (
  SELECT vec_id AS row_id, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS x FROM embeddings)"""

TRADES_SQL = """trades AS (
  SELECT date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INTEGER AS date,
    l_quantity AS weight, l_discount - l_tax AS resp,
    ((l_orderkey * 104729 + l_partkey) % 9973) / 9973.0e0 AS pred,
    ((l_orderkey + l_linenumber) % 3 = 0)::INTEGER AS y FROM lineitem)"""


# Exact halves such as 1.0653125 are rounded differently by the two engines; this moves them off.
NUDGE = "1.234e-9"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the last bits differ between engines."""
    # Adding 0.0 turns -0.0 into 0.0.
    return df.select(
        *[
            (F.round(F.col(c) + F.lit(float(NUDGE)), digits) + F.lit(0.0)).alias(c)
            if t in ("double", "float")
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def round_sql(sql_from: str, keys: list[str], values: list[str], digits: int | None = 6) -> str:
    if digits is None:
        return f"SELECT {', '.join(keys + values)} FROM {sql_from}"
    parts = keys + [f"round({v} + {NUDGE}, {digits}) + 0e0 AS {v}" for v in values]
    return f"SELECT {', '.join(parts)} FROM {sql_from}"
