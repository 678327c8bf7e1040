"""Invariants on the fixture tables, partition independence, random periods and plan shape."""

import datetime as dt
import random

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from premia.functions.dims import DRILLDOWN_DIMENSIONS
from premia.operators import budget as B
from premia.operators import kpi as K
from premia.operators import rollup as R
from premia.plans.period import Period
from premia.sources.fixture import load_tables

FULL = E.FULL


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SF_SMALL)


def test_shares_sum_to_one(t):
    for dim in DRILLDOWN_DIMENSIONS:
        for metric in ["NBW", "Renewal", "Total"]:
            rows = R.metric_drilldown(t.fact, FULL, metric, dim).collect()
            assert abs(sum(r["share_pct"] for r in rows) - 1.0) < 1e-6 * (len(rows) + 1)


def test_group_totals_reconcile(t):
    total = K.kpi_snapshot_range(t.fact, t.plan, t.forecast, FULL).collect()[0]["gwp"]
    for dim in DRILLDOWN_DIMENSIONS:
        s = sum(r["actual_gwp"] for r in R.drilldown(t.fact, FULL, dim).collect())
        assert s == pytest.approx(total, abs=0.01)
    years = sum(r["total_gwp"] for r in R.year_split(t.fact).collect())
    months = sum(r["gwp"] for r in R.monthly_kpis(t.fact).collect())
    assert years == pytest.approx(months, abs=0.01)


def test_pet_counts_bounded(t):
    distinct_all = t.fact.where(FULL.predicate(t.fact)).select("pet_id").distinct().count()
    snap = K.kpi_snapshot_range(t.fact, t.plan, t.forecast, FULL).collect()[0]
    assert snap["nbw_unique_pets"] <= distinct_all and snap["renewal_unique_pets"] <= distinct_all
    weekly = R.weekly_performance(t.fact, FULL).collect()
    assert sum(r["nbw_unique_pets"] for r in weekly) >= snap["nbw_unique_pets"]


def test_alignment_spines(t):
    q18 = B.actual_plan_forecast_range(t.fact, t.plan, t.forecast, FULL).collect()
    months = {r["month_start"] for r in q18}
    assert months == {dt.date(2001, m, 1) for m in range(1, 6)}
    assert B.plan_comparison(t.fact, t.plan, t.forecast, 2000, 2001).count() == 12


@pytest.mark.parametrize("key", ["drilldown_vendor", "kpi_snapshot_month", "weekly_performance_range",
                                 "metric_drilldown_total_state", "actual_plan_forecast_range", "top_states_month"])
def test_partition_independence(spark, key):
    q = E.queries()[key]
    results = []
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_random_periods_weekly_sums_equal_range_total(t):
    rnd = random.Random(11)
    lo, hi = dt.date(2000, 6, 1), dt.date(2001, 5, 4)
    for _ in range(4):
        a = lo + dt.timedelta(days=rnd.randrange((hi - lo).days))
        b = a + dt.timedelta(days=rnd.randrange(1, 120))
        p = Period(a, min(b, hi))
        weekly = R.weekly_performance(t.fact, p).collect()
        snap = K.kpi_snapshot_range(t.fact, t.plan, t.forecast, p).collect()[0]
        total = snap["gwp"] or 0.0
        assert sum(r["gwp"] for r in weekly) == pytest.approx(total, abs=0.01)
        assert all(p.start - dt.timedelta(days=6) <= r["week_start"] <= p.end for r in weekly)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_plan_shape(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _formatted(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_period_filter_pushed_and_pruned(spark, t):
    df = R.drilldown(t.fact, Period.month("2001-04-01"), "State")
    plan = _formatted(df)
    assert "PartitionFilters: [isnotnull(report_month" in plan
    assert "GreaterThanOrEqual(report_date,2001-04-01)" in plan and "LessThanOrEqual(report_date,2001-04-30)" in plan
    schema = [line for line in plan.split("\n") if line.startswith("ReadSchema")][0]
    assert "policy_number" not in schema and "vendor_6" not in schema  # column pruning


def test_share_reuses_main_shuffle(spark, t):
    plan = _plan(R.metric_drilldown(t.fact, FULL, "NBW", "State"))
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("period", [FULL, Period("2001-02-10", "2001-03-03"), Period("1990-01-01", "1990-02-01")])
def test_single_scan_refresh_equals_operators(spark, t, period):
    from premia.operators.refresh import RangeRefresh
    r = RangeRefresh(t.fact, t.plan, t.forecast, period)

    def same(a, b):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    same(r.kpi_snapshot(), K.kpi_snapshot_range(t.fact, t.plan, t.forecast, period))
    same(r.weekly_performance(), R.weekly_performance(t.fact, period))
    same(r.top_states(), R.top_states(t.fact, period, with_prior_year=False))
    same(r.channel_mix(), R.channel_mix(t.fact, period))
    same(r.product_mix(), R.product_mix(t.fact, period))
    same(r.growth_drivers(), R.growth_drivers(t.fact, period))
    for dim in DRILLDOWN_DIMENSIONS:
        same(r.drilldown(dim), R.drilldown(t.fact, period, dim))
        for metric in ["NBW", "Renewal", "Total"]:
            same(r.metric_drilldown(metric, dim), R.metric_drilldown(t.fact, period, metric, dim))
