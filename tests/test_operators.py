"""Operator semantics on small literal fixtures (traps T1-T19 of the design notes)."""

import datetime as dt

import pytest

from conftest import CAN, D, MTA, NEW, REI, REN, row
from premia.functions.dims import dimension
from premia.operators import budget as B
from premia.operators import kpi as K
from premia.operators import rollup as R
from premia.plans.period import Period
from premia.sources.written_details import resolve_vendor_column

APR = Period("2026-04-01", "2026-04-30")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_gwp_covers_all_codes(make_fact):
    fact = make_fact([row("2026-04-02", c, a) for c, a in
                      [(NEW, 100), (REN, 200), (MTA, 30), (CAN, -50), (REI, 40)]])
    r = one(R.growth_drivers(fact, APR))
    assert r["total_gwp"] == 320.0
    assert r["nbw_gwp"] == 100.0 and r["renewal_gwp"] == 200.0
    assert r["nbw_gwp"] + r["renewal_gwp"] != r["total_gwp"]


def test_returned_flag_null_safe(make_fact):
    rows = []
    for i, flag in enumerate([0, 1, None]):
        rows.append(row("2026-04-02", NEW, 10, pet=f"N{i}", returned=flag))
        rows.append(row("2026-04-02", REN, 10, pet=f"R{i}", returned=flag))
        rows.append(row("2026-04-02", CAN, -1, pet=f"C{i}", returned=flag))
    fact = make_fact(rows)
    r = one(R.growth_drivers(fact, APR))
    assert r["nbw_unique_pets"] == 2 and r["renewal_unique_pets"] == 2
    total = one(R.metric_drilldown(fact, APR, "Total", "Product"))
    assert total["unique_pets"] == 6  # every code, returned excluded


def test_distinct_pets_do_not_add_across_groups(make_fact):
    fact = make_fact([
        row("2026-04-06", NEW, 10, pet="P", channel="DTC"),
        row("2026-04-14", NEW, 10, pet="P", channel="Vet"),
        row("2026-04-14", REN, 10, pet="P", channel="Vet"),
    ])
    weekly = R.weekly_performance(fact, APR).collect()
    assert sum(r["nbw_unique_pets"] for r in weekly) == 2
    snap = one(K.kpi_snapshot_range(fact, fact.sparkSession.createDataFrame([], "plan_month date, metric_name string, dimension_type string, dimension_value string, plan_amount decimal(18,2)"),
                                     fact.sparkSession.createDataFrame([], "forecast_month date, metric_name string, dimension_type string, dimension_value string, forecast_amount decimal(18,2)"), APR))
    assert snap["nbw_unique_pets"] == 1 and snap["renewal_unique_pets"] == 1


def test_weeks_clipped_and_labelled_by_monday(make_fact):
    fact = make_fact([row("2026-05-03", NEW, 5), row("2026-05-04", NEW, 7), row("2026-04-20", NEW, 100)])
    weeks = R.weekly_performance(fact, Period("2026-04-29", "2026-05-04")).collect()
    assert [(r["week_start"], r["gwp"]) for r in weeks] == [(D("2026-04-27"), 5.0), (D("2026-05-04"), 7.0)]
    assert weeks[0]["gwp_wow_pct"] is None
    assert weeks[1]["gwp_wow_pct"] == pytest.approx(7 / 5 - 1)


def test_top_n_tie_break_is_deterministic(make_fact):
    fact = make_fact([row("2026-04-02", NEW, 50, state="TX"), row("2026-04-02", NEW, 50, state="AZ"),
                      row("2026-04-02", NEW, 10, state="WA")])
    top = R.top_states(fact, APR, top_n=1, with_prior_year=False).collect()
    assert [r["state"] for r in top] == ["AZ"]
    assert top[0]["share_pct"] == pytest.approx(50 / 110, abs=1e-6)


def test_null_state_never_matches_prior_year(make_fact):
    fact = make_fact([row("2026-04-02", NEW, 10, state=None), row("2025-04-02", NEW, 4, state=None),
                      row("2026-04-02", NEW, 20, state="CA"), row("2025-04-03", NEW, 10, state="CA")])
    got = {r["state"]: r for r in R.top_states(fact, Period.month("2026-04-01")).collect()}
    assert got[None]["py_gwp"] == 0.0 and got[None]["yoy_pct"] is None
    assert got["CA"]["py_gwp"] == 10.0 and got["CA"]["yoy_pct"] == 1.0
    assert set(got) == {None, "CA"}


def test_null_report_date_is_outside_every_period(make_fact, spark):
    fact = make_fact([row("2026-04-02", NEW, 10)]).union(
        spark.createDataFrame([(None, NEW, None, "X", 0, "CA", "DTC", "AI", "V")], make_fact([]).schema))
    assert one(R.growth_drivers(fact, APR))["total_gwp"] == 10.0


def test_zero_bases_give_null(make_fact):
    fact = make_fact([row("2026-04-06", NEW, 0), row("2026-04-13", NEW, 5), row("2025-04-02", NEW, 0)])
    weeks = R.weekly_performance(fact, APR).collect()
    assert weeks[1]["gwp_wow_pct"] is None  # previous week 0
    top = one(R.top_states(fact, Period.month("2026-04-01")))
    assert top["py_gwp"] == 0.0 and top["yoy_pct"] is None


def test_half_cents_round_away_from_zero(make_fact):
    # 0.25 / 2 pets = 0.125 -> 0.13 ; -0.25 / 2 = -0.125 -> -0.13
    fact = make_fact([row("2026-04-02", NEW, 0.10, pet="A"), row("2026-04-02", NEW, 0.15, pet="B"),
                      row("2026-04-02", REN, -0.10, pet="A"), row("2026-04-02", REN, -0.15, pet="B")])
    r = one(R.drilldown(fact, APR, "Product"))
    assert r["avg_nbw_premium"] == 0.13
    assert r["avg_renewal_premium"] == -0.13


def test_share_rounds_exactly_to_six_places(make_fact):
    # 1 / 16 = 0.0625 ; 0.0000005-style ties: 1 / 2,000,000 -> 0.000001
    rows = [row("2026-04-02", NEW, 1, state="A")] + [row("2026-04-02", NEW, 1999999, state="B")]
    got = {r["state"]: r for r in R.top_states(make_fact(rows), APR, with_prior_year=False).collect()}
    assert got["A"]["share_pct"] == 0.000001


def _budget(spark, rows, kind="plan"):
    schema = (f"{kind}_month date, metric_name string, dimension_type string, dimension_value string, "
              f"{kind}_amount decimal(18,2)")
    return spark.createDataFrame(rows, schema)


def test_plan_duplicates_max_versus_sum(spark, make_fact):
    fact = make_fact([row("2026-03-02", NEW, 10)])
    from decimal import Decimal as Dm
    plan = _budget(spark, [(D("2026-03-01"), "GWP", "Total", "All", Dm("100.00")),
                           (D("2026-03-01"), "GWP", "Total", "All", Dm("100.00"))])
    fc = _budget(spark, [], "forecast")
    q17 = one(B.actual_forecast_vs_plan(fact, plan, fc, 2026))
    assert q17["plan_gwp"] == 100.0
    q18 = one(B.actual_plan_forecast_range(fact, plan, fc, Period("2026-03-01", "2026-03-31")))
    assert q18["plan_gwp"] == 200.0


def test_spine_is_union_of_sources(spark, make_fact):
    from decimal import Decimal as Dm
    fact = make_fact([row("2026-01-15", NEW, 10)])
    plan = _budget(spark, [(D("2026-02-01"), "GWP", "Total", "All", Dm("5"))])
    fc = _budget(spark, [(D("2026-03-01"), "GWP", "Total", "All", Dm("7"))], "forecast")
    out = B.actual_plan_forecast_range(fact, plan, fc, Period("2026-01-01", "2026-03-31")).collect()
    assert [r["month_start"] for r in out] == [D("2026-01-01"), D("2026-02-01"), D("2026-03-01")]
    assert [r["actual_vs_plan_pct"] for r in out] == [None, -1.0, None]


def test_plan_comparison_twelve_rows_and_month_number_grouping(spark, make_fact):
    from decimal import Decimal as Dm
    fact = make_fact([row("2025-02-10", NEW, 3), row("2026-02-10", NEW, 4)])
    plan = _budget(spark, [(D("2026-02-01"), "GWP", "Total", "All", Dm("10")),
                           (D("2027-02-01"), "GWP", "Total", "All", Dm("1"))])
    fc = _budget(spark, [], "forecast")
    out = B.plan_comparison(fact, plan, fc, 2025, 2026).collect()
    assert len(out) == 12
    feb = out[1].asDict()
    assert feb["month_label"] == "Feb" and feb["plan_2026_gwp"] == 11.0
    assert feb["actual_2025_gwp"] == 3.0 and feb["actual_plus_forecast_2026_gwp"] == 4.0
    assert out[0]["actual_plus_forecast_2026_gwp"] == 0.0


def test_snapshot_month_absent_is_empty_and_gated(spark, make_fact):
    from decimal import Decimal as Dm
    fact = make_fact([row("2026-04-02", NEW, 110), row("2026-03-02", NEW, 100), row("2025-04-02", NEW, 55)])
    plan = _budget(spark, [(D("2026-04-01"), "GWP", "Total", "All", Dm("100"))])
    assert K.kpi_snapshot_month(fact, plan, "2024-01-01", 2026).count() == 0
    r = one(K.kpi_snapshot_month(fact, plan, "2026-04-01", 2026))
    assert r["gwp_mom_pct"] == pytest.approx(0.1) and r["gwp_yoy_pct"] == pytest.approx(1.0)
    assert r["gwp_vs_plan_pct"] == pytest.approx(0.1)
    r = one(K.kpi_snapshot_month(fact, plan, "2026-04-01", 2027))
    assert r["gwp_vs_plan_pct"] is None


def test_snapshot_range_on_empty_input(spark, make_fact):
    fact = make_fact([row("2026-04-02", NEW, 1)])
    r = one(K.kpi_snapshot_range(fact, _budget(spark, []), _budget(spark, [], "forecast"),
                                 Period("1990-01-01", "1990-12-31")))
    assert r["gwp"] is None and r["nbw_unique_pets"] == 0 and r["avg_nbw_premium"] is None
    assert r["renewal_pet_share"] is None and r["nbw_mix_pct"] is None


def test_ytd_prior_window_clamps_leap_day(spark, make_fact):
    fact = make_fact([row("2024-02-29", NEW, 7), row("2024-02-28", NEW, 3), row("2025-02-10", NEW, 1)])
    r = one(K.ytd_snapshot(fact, _budget(spark, []), "2025-02-01", 2026))
    assert r["py_gwp"] == 3.0  # 29 Feb 2024 is outside 2024-01-01 .. 2024-02-28
    assert r["gwp"] == 1.0


def test_unknown_dimension_and_bad_period():
    with pytest.raises(ValueError):
        dimension("Region", None)
    with pytest.raises(ValueError):
        Period.range("2026-02-01", "2026-01-01")


def test_vendor_column_priority(spark):
    def cols(*names):
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    assert resolve_vendor_column(cols("vendor_6", "vendor_5")) == "vendor_5"
    assert resolve_vendor_column(cols("vendor_6", "vendor")) == "vendor_6"
    assert resolve_vendor_column(cols("vendor")) == "vendor"
    with pytest.raises(ValueError):
        resolve_vendor_column(cols("state"))


def test_month_filter_prunes_partitions(spark, tmp_path):
    from premia.sources.written_details import read_fact, write_fact
    from conftest import FACT_SCHEMA
    rows = [row("2026-03-31", NEW, 1), row("2026-04-01", NEW, 2), row("2026-05-01", NEW, 4)]
    write_fact(spark.createDataFrame(rows, FACT_SCHEMA), str(tmp_path / "fact"))
    fact = read_fact(spark, str(tmp_path / "fact"))
    df = R.growth_drivers(fact, Period.month("2026-04-01"))
    assert one(df)["total_gwp"] == 2.0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_month" in plan or "report_month" in plan
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_monthly_view_incremental_refresh(spark, make_fact, tmp_path):
    from premia.operators.views import MonthlyView, monthly_rollup
    first = make_fact([row("2026-01-05", NEW, 10, pet="A"), row("2026-02-03", NEW, 20, pet="B")])
    later = first.union(make_fact([row("2026-02-20", NEW, 5, pet="C"), row("2026-02-21", REN, 7, pet="B"),
                                   row("2026-03-02", NEW, 1, pet="A")]))
    view = MonthlyView(str(tmp_path / "view")).build(first)
    view.refresh(later, [dt.date(2026, 2, 1), dt.date(2026, 3, 1)])
    got = sorted(map(tuple, view.read(spark).select(*monthly_rollup(later).columns).collect()))
    want = sorted(map(tuple, monthly_rollup(later).collect()))
    assert got == want
    feb = [r for r in got if r[0] == dt.date(2026, 2, 1)][0]
    assert feb[4] == 2  # NBW pets B and C: recomputed from the month's rows, not added


def test_t9_descending_order_puts_null_groups_first(spark, make_fact):
    from conftest import FACT_SCHEMA
    fact = make_fact([row("2026-04-02", NEW, 50, channel="DTC"), row("2026-04-02", NEW, 10, channel="Vet")]).union(
        spark.createDataFrame([(D("2026-04-03"), NEW, None, "X", 0, "CA", "Partner", "AI", "V")], FACT_SCHEMA))
    out = R.drilldown(fact, APR, "Channel").collect()
    assert [r["drilldown_group"] for r in out] == ["Partner", "DTC", "Vet"]  # null GWP first, like PostgreSQL DESC


def test_t13_partial_range_compares_with_full_month_plan(spark, make_fact):
    from decimal import Decimal as Dm
    fact = make_fact([row("2026-02-10", NEW, 10), row("2026-02-05", NEW, 1000)])
    plan = _budget(spark, [(D("2026-02-01"), "GWP", "Total", "All", Dm("100")),
                           (D("2026-03-01"), "GWP", "Total", "All", Dm("999"))])
    r = one(K.kpi_snapshot_range(fact, plan, _budget(spark, [], "forecast"), Period("2026-02-10", "2026-02-20")))
    assert r["gwp"] == 10.0 and r["plan_gwp"] == 100.0  # actual by day, plan by whole February
    assert r["gwp_vs_plan_pct"] == pytest.approx(-0.9)


def test_t18_null_current_gives_null_change(spark):
    from premia.functions import measures as Mm
    df = spark.createDataFrame([(None, 5.0), (6.0, None), (6.0, 0.0), (6.0, 3.0)], "c double, b double")
    got = [r[0] for r in df.select(Mm.pct_change("c", "b")).collect()]
    assert got == [None, None, None, 1.0]


def test_t19_range_snapshot_has_no_plan_year_gate(spark, make_fact):
    from decimal import Decimal as Dm
    fact = make_fact([row("2031-04-02", NEW, 50)])
    plan = _budget(spark, [(D("2031-04-01"), "GWP", "Total", "All", Dm("100"))])
    r = one(K.kpi_snapshot_range(fact, plan, _budget(spark, [], "forecast"), Period("2031-04-01", "2031-04-30")))
    assert r["gwp_vs_plan_pct"] == pytest.approx(-0.5)
    m = one(K.kpi_snapshot_month(fact, plan, "2031-04-01", plan_year=2026))
    assert m["gwp_vs_plan_pct"] is None  # the month snapshot is gated
