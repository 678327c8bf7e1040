"""Post-query transforms of the dashboard: executive trend, weekly highlights,
masked trend, YTD comparison rows, top growth channels, full-year totals and the
default reporting period.

They take operator results (small, already aggregated DataFrames) and stay
distributed: arg-max / arg-min are aggregates over structs, not driver loops.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as FM
from ..plans.period import as_date
from .budget import month_spine


def _exists_sum(cond: Column, value: str) -> Column:
    """pandas ``groupby().sum()`` of the selected rows: no rows -> null, all-null -> 0."""
    return F.when(F.count(F.when(cond, F.lit(1))) > 0,
                  F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0)))


# X1
def exec_trend(trend: DataFrame, afvp: DataFrame, trend_year: int, base_year: int, plan_year: int,
               actuals_cutoff: int, forecast_from: int | None = None) -> DataFrame:
    """Twelve-month view: actual GWP for three years (the plan year only up to the
    actuals cutoff), plan for every month, forecast from ``forecast_from`` on.

    ``trend`` is the monthly trend (month_start, gwp); ``afvp`` the actual /
    forecast / plan comparison (month_start, plan_gwp, forecast_gwp). All are stacked
    and grouped by month number once; a month with several distinct plan or forecast
    values gives a row for each, as a merge would (a one-year plan has one).
    """
    forecast_from = forecast_from or actuals_cutoff + 1
    ms = F.col("month_start")
    yr, mn = F.year(ms), F.month(ms)
    actuals = trend.select(mn.alias("month_num"), "month_start", "gwp")
    budget = afvp.select(mn.alias("month_num"), F.struct(F.col("plan_gwp").alias("v")).alias("plan"),
                         F.when(mn >= forecast_from, F.struct(F.col("forecast_gwp").alias("v"))).alias("fc"))
    stacked = (month_spine(trend.sparkSession).unionByName(actuals, allowMissingColumns=True)
               .unionByName(budget, allowMissingColumns=True))
    g = stacked.groupBy("month_num").agg(
        F.max("month_label").alias("month_label"),
        _exists_sum(yr == trend_year, "gwp").alias(f"actual_{trend_year}"),
        _exists_sum(yr == base_year, "gwp").alias(f"actual_{base_year}"),
        _exists_sum((yr == plan_year) & (mn <= actuals_cutoff), "gwp").alias(f"actual_{plan_year}"),
        F.collect_set("plan").alias("plans"), F.collect_set("fc").alias("fcs"))
    return (g.withColumn("p", F.explode_outer("plans")).withColumn("f", F.explode_outer("fcs"))
            .select("month_num", "month_label", f"actual_{trend_year}", f"actual_{base_year}", f"actual_{plan_year}",
                    F.col("p.v").alias(f"plan_{plan_year}"), F.col("f.v").alias(f"forecast_{plan_year}"))
            .orderBy("month_num"))


def _argbest(value: str, largest: bool) -> Column:
    """The week with the largest (or smallest) value; the earliest week on ties."""
    key = F.col(value) if largest else -F.col(value)
    s = F.struct(key.alias("v"), (-F.unix_date("week_start")).alias("w"))
    best = F.max(F.when(F.col(value).isNotNull(), s))
    return F.date_from_unix_date(-best.getField("w"))


# X2
def weekly_highlights(weekly: DataFrame) -> DataFrame:
    """Best / weakest week GWP, mean weekly GWP, and the labels of the best NBW and
    best renewal weeks, from the weekly performance rows (one global aggregate)."""
    g = weekly.agg(
        _argbest("gwp", True).alias("best_week_start"),
        F.max("gwp").alias("best_week_gwp"),
        _argbest("gwp", False).alias("weakest_week_start"),
        F.min("gwp").alias("weakest_week_gwp"),
        F.round(F.avg(F.col("gwp").cast("decimal(20,2)")), 6).cast("double").alias("avg_weekly_gwp"),
        _argbest("nbw_gwp", True).alias("best_nbw_week_start"),
        _argbest("renewal_gwp", True).alias("best_renewal_week_start"),
        F.count(F.lit(1)).alias("n_weeks"))
    return g.where(F.col("n_weeks") > 0).select(
        "best_week_start", "best_week_gwp", "weakest_week_start", "weakest_week_gwp", "avg_weekly_gwp",
        FM.week_label("best_nbw_week_start").alias("best_nbw_week_label"),
        FM.week_label("best_renewal_week_start").alias("best_renewal_week_label"))


MASKED = ["nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets",
          "avg_nbw_premium", "avg_renewal_premium"]


# X3
def trend_masked(trend: DataFrame, plan_year: int, actuals_cutoff: int) -> DataFrame:
    """Monthly trend with ``*_clean`` copies of six measures that are null for the
    plan year's months after the actuals cutoff."""
    ms = F.col("month_start")
    keep = ~((F.year(ms) == plan_year) & (F.month(ms) > actuals_cutoff))
    return trend.select("*", *[F.when(keep, F.col(c)).alias(f"{c}_clean") for c in MASKED]).orderBy("month_start")


# X4
def ytd_compare(ytd: DataFrame) -> DataFrame:
    """The YTD snapshot's one row as three rows: GWP, NBW GWP, renewal GWP against
    plan and prior year."""
    return ytd.select(F.expr(
        "stack(3, 'GWP', gwp, plan_gwp, py_gwp, "
        "'NBW GWP', nbw_gwp, plan_nbw_gwp, py_nbw_gwp, "
        "'Renewal GWP', renewal_gwp, plan_renewal_gwp, py_renewal_gwp) "
        "as (metric, ytd_actual, ytd_plan, prior_ytd)"))


# X5
def top_growth_channels(growth: DataFrame, n: int = 5) -> DataFrame:
    return growth.orderBy(F.desc_nulls_first("total_gwp"), F.asc_nulls_first("iph_channel_5")).limit(n)


# X6
def full_year_totals(comparison: DataFrame, base_year: int, plan_year: int) -> DataFrame:
    """Column totals of the plan comparison (nulls skipped; all-null gives 0)."""
    def tot(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c).cast("decimal(20,2)")), F.lit(0)).cast("double")
    return comparison.agg(
        tot(f"actual_{base_year}_gwp").alias(f"fy_{base_year}_actual"),
        tot(f"plan_{plan_year}_gwp").alias(f"fy_{plan_year}_plan"),
        tot(f"actual_plus_forecast_{plan_year}_gwp").alias(f"fy_{plan_year}_actual_plus_forecast"))


# X10
def default_period(bounds: DataFrame, configured_start: str | dt.date) -> DataFrame:
    """Default dashboard period from the date bounds: start = later of the configured
    start and the first date, end = last date, selected month = first of the end
    month, with a validity flag (start after end is an error for the caller)."""
    start = F.greatest(F.lit(as_date(configured_start)), F.col("min_date"))
    return bounds.select(
        start.alias("start_date"), F.col("max_date").alias("end_date"),
        F.trunc("max_date", "month").alias("selected_month"),
        FM.month_display(F.trunc("max_date", "month")).alias("selected_month_display"),
        (start <= F.col("max_date")).alias("is_valid"))
