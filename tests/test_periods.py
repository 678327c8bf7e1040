"""Tables of periods, stored bitmaps, gapless ids, SQL functions and date text against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import CAN, D, MTA, NEW, REN, row
from premia.functions import formats as FM
from premia.functions.ids import with_gapless_ids
from premia.functions.sql_functions import register_functions
from premia.operators.periods import PeriodReport, month_pairs, period_measures
from premia.operators.pet_bitmaps import PetBitmaps
from premia.operators.rollup import date_bounds, drilldown
from premia.plans.period import Period
from premia.sources.written_details import footer_scan, read_fact, write_fact

PERIOD = "period_id string, start_date date, end_date date"


def some_rows(n=400, seed=5):
    r = random.Random(seed)
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    return [row(str(r.choice(days)), r.choice([NEW, NEW, REN, REN, MTA, CAN]), r.randrange(-500, 900) / 4,
                r.choice([None, "HOT", "HOT", *(f"P{k}" for k in range(25))]), r.choice([None, 0, 0, 1]),
                r.choice([None, "CA", "NY"]), r.choice(["DTC", "Vet"]), r.choice(["AI", None])) for _ in range(n)]


def brute(rows, start, end, col=None):
    out = {}
    for x in rows:
        if start <= x[0] <= end:
            g = out.setdefault(None if col is None else x[col], [0, 0, 0, set(), set()])
            g[0] += x[2]
            for k, code in ((1, NEW), (2, REN)):
                if x[1] == code:
                    g[k] += x[2]
                    if (x[4] or 0) != 1 and x[3] is not None:
                        g[k + 2].add(x[3])
    return {k: (g[0], g[1], g[2], len(g[3]), len(g[4])) for k, g in out.items()}


def some_periods():
    r = random.Random(9)
    out = [("all", D("2025-01-01"), D("2025-04-30")), ("none", D("2019-01-01"), D("2019-02-01")), ("day", D("2025-02-03"), D("2025-02-03"))]
    for i in range(30):
        a, b = sorted(r.randrange(-5, 125) for _ in range(2))
        out.append((f"r{i}", D("2025-01-01") + dt.timedelta(days=a), D("2025-01-01") + dt.timedelta(days=b)))
    return out + [("again", *out[4][1:])]


def test_measures_of_every_period(spark, make_fact):
    rows, periods = some_rows(), some_periods()
    got = period_measures(make_fact(rows), spark.createDataFrame(periods, PERIOD)).collect()
    for kind, col in (("total", None), ("state", 5), ("channel", 6), ("product", 7)):
        for i, a, b in periods:
            have = {r.grp: (r.gwp, r.nbw_gwp, r.renewal_gwp, r.nbw_unique_pets, r.renewal_unique_pets)
                    for r in got if r.period_id == i and r.set == kind}
            assert have == brute(rows, a, b, col), (kind, i)


def test_no_periods_and_bad_periods(spark, make_fact):
    fact = make_fact(some_rows(20))
    assert period_measures(fact, spark.createDataFrame([], PERIOD)).collect() == []
    for bad in (("x", D("2025-02-01"), D("2025-01-01")), ("x", None, D("2025-01-01"))):
        with pytest.raises(ValueError):
            period_measures(fact, spark.createDataFrame([bad], PERIOD))
    assert period_measures(fact.limit(0), spark.createDataFrame(some_periods(), PERIOD)).count() == 0


def test_one_scan_for_all_periods(spark, make_fact, tmp_path):
    write_fact(make_fact(some_rows()), str(tmp_path / "f"))
    plan = period_measures(read_fact(spark, str(tmp_path / "f")), month_pairs(spark, "2025-01-01", "2025-04-01"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text
    assert plan.where("set = 'total'").count() == 10


def test_bitmaps_count_any_range(spark, make_fact):
    rows = some_rows()
    store = PetBitmaps.build(make_fact(rows))
    for kind, col in (("total", None), ("State", 5), ("Product", 7)):
        for _, a, b in some_periods()[:12]:
            got = {r.grp: tuple(r)[1:] for r in store.measures(Period(a, b), kind).collect()}
            assert got == brute(rows, a, b, col)
    with pytest.raises(ValueError):
        store.drilldown(Period("2025-01-01", "2025-02-01"), "Vendor")
    assert PetBitmaps.build(make_fact([])).measures(Period("2025-01-01", "2025-02-01"), "State").count() == 0


def test_gapless_ids(spark):
    r = random.Random(2)
    values = [(r.randrange(50), r.choice([None, "a", "b"])) for _ in range(3000)]
    df = spark.createDataFrame(values, "x int, y string").repartition(7)
    got = with_gapless_ids(df, [F.asc_nulls_first("x"), F.asc_nulls_first("y")]).orderBy("id").collect()
    assert [g.id for g in got] == list(range(1, 3001))
    assert [(g.x, g.y) for g in got] == sorted(values, key=lambda v: (v[0], v[1] is not None, v[1] or ""))
    assert with_gapless_ids(df.limit(0), [F.col("x")]).count() == 0


def test_sql_functions(spark, make_fact, tmp_path):
    write_fact(make_fact(some_rows()), str(tmp_path / "f"))
    fact = read_fact(spark, str(tmp_path / "f"))
    fact.createOrReplaceTempView("fact_written_details")
    register_functions(spark)
    call = "SELECT * FROM drilldown(DATE'2025-01-10', DATE'2025-03-05', '{}')"
    for dim in ("State", "Channel", "Product", "Vendor"):
        want = drilldown(fact, Period("2025-01-10", "2025-03-05"), dim)
        assert sorted(spark.sql(call.format(dim)).collect(), key=str) == sorted(want.collect(), key=str)
    plan = spark.sql(call.format("State"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(report_date,2025-01-10)" in plan and "PartitionFilters: [isnotnull(report_month" in plan
    with pytest.raises(Exception, match="Invalid drilldown group"):
        spark.sql(call.format("Planet")).collect()


def test_bounds_and_counts_from_footers(spark, make_fact, tmp_path):
    write_fact(make_fact(some_rows()), str(tmp_path / "f"))
    fact = read_fact(spark, str(tmp_path / "f"))
    footers = footer_scan(spark, str(tmp_path / "f"), fact.schema)
    bounds = date_bounds(footers)
    assert bounds.collect() == date_bounds(fact).collect() and footers.agg(F.count(F.lit(1))).first()[0] == 400
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(report_date), MAX(report_date)]" in plan


@pytest.mark.parametrize("texts,want,share", [
    (["01/31/2026", "2/1/2026", "12/05/2025", None, "13/13/2026", "1/2/2026"], ["2026-01-31", "2026-02-01", "2025-12-05"], 4 / 6),
    (["Jan 31, 2026", "Feb 1, 2026", "Dec 25, 2025"], ["2026-01-31", "2026-02-01", "2025-12-25"], 1.0),
    (["2026-01-31", "2026-02-01", "x"], ["2026-01-31", "2026-02-01", None], 2 / 3),
    (["CA", "NY", "1 Main St"], ["CA", "NY", "1 Main St"], 0.0)])
def test_date_text(spark, texts, want, share):
    df = spark.createDataFrame([(t,) for t in texts], "drilldown_group string")
    assert FM.date_share(df, "drilldown_group").first()[0] == pytest.approx(share)
    parsed = [r[0] for r in FM.parse_date_column(df, "drilldown_group", 0.5).collect()]
    assert parsed[:len(want)] == want
    if share > 0.8:
        assert [r[0] for r in FM.format_report(df).collect()] == want


def test_report_of_periods_matches_single_ranges(spark, make_fact):
    from premia.operators import kpi as K
    from premia.sources.fixture import forecast_fixture, plan_fixture
    plan = plan_fixture(spark, 2025)
    forecast = forecast_fixture(plan)
    fact = make_fact(some_rows())
    periods = some_periods()[:4]
    report = PeriodReport(fact, plan, forecast, spark.createDataFrame(periods, PERIOD))
    got = {r.period_id: tuple(r)[1:] for r in report.kpi_snapshots().collect()}
    assert got == {i: tuple(K.kpi_snapshot_range(fact, plan, forecast, Period(a, b)).first()) for i, a, b in periods}
    blocks = dict(tuple(r) for r in report.block("states").collect())
    assert blocks["none"] == "No state data available." and blocks["all"].count("\n") == 2
    with pytest.raises(ValueError):
        report.block("planets")
