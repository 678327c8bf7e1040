"""Formatting and narrative: compared with Python's own formatting (brute force)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import NEW, REN, row
from premia.functions import formats as FM
from premia.operators import narrative as N
from premia.operators import transforms as X
from premia.operators import rollup as R
from premia.plans.period import Period

VALUES = [2.5, 1234566.5, -1234.5, 0.1225, None, 0.0, -0.0001, 3.5, 1e9 + 0.5, 0.9995, -2.5]


def py_currency(x):
    return "—" if x is None else f"${x:,.0f}"


def py_number(x):
    return "—" if x is None else f"{x:,.0f}"


def py_pct(x):
    return "—" if x is None else f"{x:.1%}"


def test_formatters_match_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = df.select("x", FM.fmt_currency("x").alias("c"), FM.fmt_number("x").alias("n"),
                    FM.fmt_pct("x").alias("p"), FM.plan_delta_label("x").alias("d")).collect()
    for r in got:
        assert r["c"] == py_currency(r["x"])
        assert r["n"] == py_number(r["x"])
        assert r["p"] == py_pct(r["x"])
        assert r["d"] == "vs Plan " + py_pct(r["x"])


def test_random_formatting_matches_python(spark):
    import random
    rnd = random.Random(7)
    vals = [round(rnd.uniform(-1e7, 1e7), 2) for _ in range(300)] + [rnd.random() for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", FM.fmt_currency("x").alias("c"), FM.fmt_pct("x").alias("p")).collect():
        assert r["c"] == py_currency(r["x"]) and r["p"] == py_pct(r["x"])


def test_date_detection_threshold(spark):
    def share_fmt(values):
        df = spark.createDataFrame([(v,) for v in values], "drilldown_group string")
        return [r[0] for r in FM.format_report(df).collect()]
    mostly = ["2026-01-05"] * 9 + ["CA"]
    assert share_fmt(mostly)[0] == "2026-01-05"
    exactly = ["2026-01-05"] * 8 + ["CA", "TX"]
    assert share_fmt(exactly) == exactly  # 80% is not more than 80%: kept as text


def test_week_label_and_month_display(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 5),), (dt.date(2026, 11, 30),)], "d date")
    got = df.select(FM.week_label("d"), FM.month_display("d")).collect()
    assert [tuple(r) for r in got] == [("Jan 5, 2026", "January 2026"), ("Nov 30, 2026", "November 2026")]


def test_lines_block_order_limit_and_fallback(spark, make_fact):
    fact = make_fact([row("2026-04-02", NEW, 10 * i, state=f"S{i}") for i in range(1, 8)])
    period = Period("2026-04-01", "2026-04-30")
    text = N.blocks(fact, period)["states"].collect()[0][0]
    lines = text.split("\n")
    assert len(lines) == 5 and lines[0].startswith("- S7: current GWP $70, YoY —, share ")
    empty = N.blocks(fact, Period("1990-01-01", "1990-01-31"))
    assert empty["states"].collect()[0][0] == N.FALLBACK_STATES
    assert empty["weeks"].collect()[0][0] == N.FALLBACK_WEEKS


def test_template_fill_matches_python_format(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    tpl = "A {x} and {y}!"
    got = df.select(N.fill(tpl, {"x": F.col("x"), "y": N._py_str("y")})).collect()[0][0]
    assert got == tpl.format(x="a", y=None)


def test_weekly_highlights_first_on_ties(make_fact):
    fact = make_fact([row("2026-04-06", NEW, 5), row("2026-04-13", NEW, 5), row("2026-04-20", REN, 1)])
    h = X.weekly_highlights(R.weekly_performance(fact, Period("2026-04-01", "2026-04-30"))).collect()[0]
    assert h["best_week_start"] == dt.date(2026, 4, 6)
    assert h["weakest_week_start"] == dt.date(2026, 4, 20)
    assert h["best_nbw_week_label"] == "Apr 6, 2026"
    assert h["avg_weekly_gwp"] == pytest.approx(11 / 3, abs=1e-6)
