"""The fact bucketed by pet: equal results, hot pets and missing pets apart, no shuffle of (group, pet) rows."""

import pytest

from conftest import FACT_SCHEMA, NEW, REN
from premia.operators import rollup as R
from premia.operators.kpi import kpi_snapshot_range
from premia.operators.pet_buckets import PetBuckets
from premia.plans.period import Period
from premia.sources.schema import FORECAST_SCHEMA, PLAN_SCHEMA
from test_skew import _rows

YEAR = Period("2026-01-01", "2026-04-30")


def _plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def even_rows():
    return [r for r in _rows() if r[3] != "HOT"]


def test_hot_and_missing_pets_stay_apart_and_results_are_equal(spark):
    rows = _rows() + [r[:3] + (None,) + r[4:] for r in _rows(600, seed=9)]
    fact = spark.createDataFrame(rows, FACT_SCHEMA).repartition(5)
    store = PetBuckets.build(fact, buckets=8)
    assert {r[0] for r in store.hot.select("pet_id").distinct().collect()} == {"HOT", None}
    assert store.hot.count() + store.even.count() == len(rows)
    assert store.even.where("pet_id is null or pet_id = 'HOT'").count() == 0
    for period in (YEAR, Period("2026-02-10", "2026-03-05"), Period("1990-01-01", "1990-12-31")):
        for dim in ("Channel", "State", "Vendor", "Week"):
            assert store.drilldown(period, dim).collect() == R.drilldown(fact, period, dim).collect()
        assert (store.metric_drilldown(period, "NBW", "Channel").collect()
                == R.metric_drilldown(fact, period, "NBW", "Channel").collect())
        plan, forecast = (spark.createDataFrame([], s) for s in (PLAN_SCHEMA, FORECAST_SCHEMA))
        assert (store.kpi_snapshot_range(plan, forecast, period).collect()
                == kpi_snapshot_range(fact, plan, forecast, period).collect())


def test_only_group_rows_are_shuffled(spark, even_rows):
    store = PetBuckets.build(spark.createDataFrame(even_rows, FACT_SCHEMA).repartition(5), buckets=8)
    assert store.hot is None
    for dim, exchange in (("Vendor", "Exchange hashpartitioning(Vendor"), ("Channel", "Exchange hashpartitioning(Channel")):
        plan = _plan(store.drilldown(YEAR, dim))
        assert plan.count("Exchange hashpartitioning") == 1 and exchange in plan
        assert "SelectedBucketsCount: 8 out of 8" in plan and "report_month" in plan.split("PartitionFilters")[1]
    whole = _plan(store.measures(YEAR, [], R.M.core_measures()))
    assert "hashpartitioning" not in whole and whole.count("Exchange SinglePartition") == 1


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(YEAR.start, NEW, None, "P", 0, "CA", "DTC", "AI", "V"),
                                 (YEAR.start, REN, None, None, 0, None, None, None, None)], FACT_SCHEMA)
    assert PetBuckets.build(one, buckets=4).drilldown(YEAR, "State").collect() == R.drilldown(one, YEAR, "State").collect()
    none = PetBuckets.build(one.limit(0), buckets=4)
    assert none.hot is None and none.drilldown(YEAR, "State").collect() == []
    assert none.measures(YEAR, [], R.M.core_measures()).collect() == [(None, None, None, 0, 0)]
