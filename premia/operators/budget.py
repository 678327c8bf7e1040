"""Actual / plan / forecast alignment by month.

All three sides are reduced to at most one row per month before they meet, so
whatever joins them is bounded by the number of months, not by the data. The
union-of-months spine is built by stacking the three monthly frames and grouping
by month (one small shuffle) rather than by a distinct union plus three joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import vocab as V
from ..functions.dims import dimension
from ..plans.period import Period
from .kpi import PLAN_METRICS, budget_total

FIVE = PLAN_METRICS[:5]


def _pivot_max(budget: DataFrame, month_col: str, amount_col: str, prefix: str) -> DataFrame:
    b = budget.where(F.col("dimension_type") == V.TOTAL_DIMENSION)
    return b.groupBy(F.col(month_col).alias("month_start")).agg(
        *[F.max(F.when(F.col("metric_name") == k, F.col(amount_col))).alias(f"{prefix}_{s}") for k, s in FIVE])


# Q17
def actual_forecast_vs_plan(fact: DataFrame, plan: DataFrame, forecast: DataFrame, plan_year: int,
                            monthly: DataFrame | None = None) -> DataFrame:
    """Plan months drive the rows; actuals are the plan year's months; MAX pivots
    (duplicate Total rows are not added)."""
    year = Period(f"{plan_year}-01-01", f"{plan_year}-12-31")
    if monthly is None:
        src = year.filter(fact)
        actual = M.aggregate(src, {"month_start": dimension("Month", src)}, M.core_measures())
    else:
        actual = monthly.where(year.contains("month_start"))
    actual = actual.select("month_start", *[F.col(s).alias(f"actual_{s}") for _, s in FIVE])
    plan_total = _pivot_max(plan, "plan_month", "plan_amount", "plan")
    fc_total = _pivot_max(forecast, "forecast_month", "forecast_amount", "forecast")
    out = (plan_total.join(actual, "month_start", "left").join(fc_total, "month_start", "left")
           .select("month_start", *[f"actual_{s}" for _, s in FIVE], *[f"forecast_{s}" for _, s in FIVE],
                   *[f"plan_{s}" for _, s in FIVE])
           .orderBy("month_start"))
    return M.as_output(out)


# Q18
def actual_plan_forecast_range(fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period) -> DataFrame:
    """Every month present in any of actual (by day in the range), plan or forecast
    (by whole month); missing values are 0. Actual and forecast of the same month
    are both counted in ``actual_plus_forecast_gwp``."""
    src = period.filter(fact)
    actual = M.aggregate(src, {"month_start": dimension("Month", src)}, M.core_measures())
    actual = actual.select("month_start", *[F.col(s).alias(f"actual_{s}") for _, s in FIVE])
    months = period.months()
    p = budget_total(plan, "plan_month", "plan_amount", "plan", FIVE, True, months, "month_start")
    f = budget_total(forecast, "forecast_month", "forecast_amount", "forecast", FIVE, True, months, "month_start")
    return range_months(actual, p, f, []).orderBy("month_start")


def range_months(actual: DataFrame, plan: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Months of the three sources aligned, per value of ``keys``."""
    stacked = actual.unionByName(plan, allowMissingColumns=True).unionByName(forecast, allowMissingColumns=True)
    cols = [c for c in stacked.columns if c not in ("month_start", *keys)]
    m = stacked.groupBy(*keys, "month_start").agg(*[F.max(c).alias(c) for c in cols])
    z = {c: F.coalesce(F.col(c), F.lit(0)) for c in cols}
    money = [f"{k}_{s}" for k in ("actual", "plan", "forecast") for s in ("gwp", "nbw_gwp", "renewal_gwp")]
    out_cols = []
    for k in ("actual", "plan", "forecast"):
        for _, s in FIVE:
            c = f"{k}_{s}"
            out_cols.append((F.round(z[c], 2) if c in money else z[c]).alias(c))
    a, pl, fc = z["actual_gwp"], z["plan_gwp"], z["forecast_gwp"]
    out = m.select(
        *keys, "month_start", *out_cols,
        F.round(a + fc, 2).alias("actual_plus_forecast_gwp"),
        F.round(a - pl, 2).alias("actual_vs_plan_gwp"),
        F.when(pl == 0, F.lit(None)).otherwise(M.ratio(a - pl, F.col("plan_gwp"))).alias("actual_vs_plan_pct"),
    )
    return M.as_output(out)


def month_spine(spark) -> DataFrame:
    """The 12 calendar months with their short labels (a literal relation)."""
    labels = F.array(*[F.lit(x) for x in V.MONTH_LABELS])
    return (spark.range(1)
            .select(F.posexplode(labels).alias("pos", "month_label"))
            .select((F.col("pos") + 1).cast("int").alias("month_num"), "month_label"))


# Q19
def plan_comparison(fact: DataFrame, plan: DataFrame, forecast: DataFrame, base_year: int, plan_year: int,
                    monthly: DataFrame | None = None) -> DataFrame:
    """Twelve rows: base-year actual, plan, plan-year actual and forecast by month
    number. Plan and forecast are grouped by month number over all their years."""
    a_base, p_plan = f"actual_{base_year}_gwp", f"plan_{plan_year}_gwp"
    a_plan, f_plan = f"actual_{plan_year}_gwp", f"forecast_{plan_year}_gwp"
    if monthly is None:
        yrs = [Period(f"{y}-01-01", f"{y}-12-31") for y in (base_year, plan_year)]
        from ..plans.period import union_predicate
        rows, date_col, amount = fact.where(union_predicate(fact, yrs)), "report_date", M.AMOUNT
    else:
        rows, date_col, amount = monthly, "month_start", "gwp"
    yr = F.year(date_col)
    actual = rows.groupBy(F.month(date_col).alias("month_num")).agg(
        F.sum(F.when(yr == base_year, F.col(amount))).alias(a_base),
        F.sum(F.when(yr == plan_year, F.col(amount))).alias(a_plan))
    tot = F.col("dimension_type") == V.TOTAL_DIMENSION
    p = (plan.where(tot).groupBy(F.month("plan_month").alias("month_num"))
         .agg(F.sum(F.when(F.col("metric_name") == "GWP", F.col("plan_amount"))).alias(p_plan)))
    f = (forecast.where(tot).groupBy(F.month("forecast_month").alias("month_num"))
         .agg(F.sum(F.when(F.col("metric_name") == "GWP", F.col("forecast_amount"))).alias(f_plan)))
    spine = month_spine(fact.sparkSession)
    stacked = (spine.unionByName(actual, allowMissingColumns=True)
               .unionByName(p, allowMissingColumns=True).unionByName(f, allowMissingColumns=True))
    g = stacked.groupBy("month_num").agg(
        F.max("month_label").alias("month_label"),
        *[F.max(c).alias(c) for c in (a_base, p_plan, a_plan, f_plan)])
    out = g.where(F.col("month_label").isNotNull()).select(
        "month_num", "month_label", a_base, p_plan, a_plan, f_plan,
        (F.coalesce(F.col(a_plan), F.lit(0)) + F.coalesce(F.col(f_plan), F.lit(0)))
        .alias(f"actual_plus_forecast_{plan_year}_gwp")).orderBy("month_num")
    return M.as_output(out)
