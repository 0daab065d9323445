import re

import pytest

import __spark_entry__ as entry
from checks.compare import check, oracle


def test_registered_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    own = [n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)]
    assert len(own) > 100


@pytest.mark.parametrize("name", ["zscore_strategy", "lag_features", "purged_splits_gap", "drop_zero_weight", "auc_by_day"])
def test_a_few_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    ok, text = check(spark, oracle(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, text


def test_flagship(spark):
    made = entry.entry(spark)
    assert made.columns == ["fold", "utility"] and made.count() > 0
