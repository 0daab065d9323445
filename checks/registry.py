"""All registered queries and their SQL."""

from __future__ import annotations

from checks import evaluation, fitted, flows, kept_rows, strategy, tables, timeseries

MODULES = (strategy, timeseries, tables, evaluation, kept_rows, fitted, flows)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q for m in MODULES for name, q in m.SQL.items()}


def flagship(spark, sf_dir):
    return strategy.strategy(spark, sf_dir)
