import pytest

from tests.compare import same
from tests.conftest import SF_ORACLE
from tidelog.plans.base import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    same(QUERIES[name](spark, SF_ORACLE), duck(SF_ORACLE).sql(SQL[name]))


def test_comparison_finds_a_wrong_value(spark, duck):
    c = duck(SF_ORACLE)
    with pytest.raises(AssertionError):
        same(QUERIES["kv_totals"](spark, SF_ORACLE), c.sql(SQL["kv_totals"].replace("op = 0", "op = 1")))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_key_range_reaches_the_scan(spark, tmp_path):
    from tidelog.operators import resolve

    log = spark.createDataFrame([(1, 0, "a", "x"), (2, 0, "b", "y")], "seq long, op int, key string, value string")
    log.write.parquet(str(tmp_path / "log"))
    plan = resolve.scan(spark.read.parquet(str(tmp_path / "log")), "a", "b")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan
    assert "EqualTo(op" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in plan
