"""Single-row KPI snapshots: month, date range, year-to-date; and the change helper.

The source joined one-row aggregates with ``LEFT JOIN ... ON TRUE``. Here each
input is reduced to one row and the rows are stacked and collapsed with one global
aggregate (``max`` of each column, since every column is filled by exactly one
input): no join, no cross product, one tiny final exchange.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import vocab as V
from ..functions.dims import dimension
from ..plans.period import Period, add_months, add_years, as_date, month_start, union_predicate

CORE = ["gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets"]
PLAN_METRICS = [  # (metric name, column suffix)
    ("GWP", "gwp"),
    ("NBW_GWP", "nbw_gwp"),
    ("RENEWAL_GWP", "renewal_gwp"),
    ("NBW_UNIQUE_PETS", "nbw_unique_pets"),
    ("RENEWAL_UNIQUE_PETS", "renewal_unique_pets"),
    ("AVG_NBW_PREMIUM", "avg_nbw_premium"),
    ("AVG_RENEWAL_PREMIUM", "avg_renewal_premium"),
]


def one_row(*frames: DataFrame) -> DataFrame:
    """Collapse one-row frames with disjoint columns into a single row."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def budget_total(budget: DataFrame, month_col: str, amount_col: str, prefix: str,
                 metrics: list[tuple[str, str]], else_zero: bool, period: Period | None = None,
                 group_by_month: str | None = None) -> DataFrame:
    """Conditional sums of the long-format budget (``Total`` rows) per metric.

    ``else_zero`` selects ``SUM(CASE ... ELSE 0)`` against ``SUM(CASE ...)``; on an
    empty input both give null (global aggregate).
    """
    b = budget.where(F.col("dimension_type") == V.TOTAL_DIMENSION)
    if period is not None:
        b = b.where(F.col(month_col).between(F.lit(period.start), F.lit(period.end)))
    aggs = []
    for metric, suffix in metrics:
        val = F.when(F.col("metric_name") == metric, F.col(amount_col))
        if else_zero:
            val = val.otherwise(F.lit(0))
        aggs.append(F.sum(val).alias(f"{prefix}_{suffix}"))
    if group_by_month:
        return b.groupBy(F.col(month_col).alias(group_by_month)).agg(*aggs)
    return b.agg(*aggs)


def _vs_plan(actual: str, plan: str, gated: bool) -> Column:
    return M.pct_change(actual, plan) if gated else F.lit(None).cast("double")


def _pet_share() -> Column:
    nbw = F.coalesce(F.col("nbw_unique_pets"), F.lit(0))
    ren = F.coalesce(F.col("renewal_unique_pets"), F.lit(0))
    total = nbw + ren
    return F.when(total > 0, ren.cast("double") / total.cast("double"))


# Q6
def kpi_snapshot_month(fact: DataFrame, plan: DataFrame, selected_month, plan_year: int,
                       monthly: DataFrame | None = None) -> DataFrame:
    """The month's KPIs with prior month, prior year and plan; empty if the month has no rows.

    Versus-plan changes are filled only when the month lies in ``plan_year``. With
    the materialised monthly view the three months are read from it; otherwise one
    scan of the three months' partitions aggregates them.
    """
    m = month_start(as_date(selected_month))
    prev, py = add_months(m, -1), add_years(m, -1)
    if monthly is None:
        src = fact.where(union_predicate(fact, [Period.month(x) for x in (m, prev, py)]))
        monthly = M.aggregate(src, {"month_start": dimension("Month", src)}, M.core_measures())
    else:
        monthly = monthly.where(F.col("month_start").isin([F.lit(x) for x in (m, prev, py)]))
    ms = F.col("month_start")
    actual = monthly.agg(
        F.max(F.when(ms == F.lit(m), ms)).alias("month_start"),
        *[F.max(F.when(ms == F.lit(m), F.col(c))).alias(c) for c in CORE],
        F.max(F.when(ms == F.lit(prev), F.col("gwp"))).alias("prev_gwp"),
        F.max(F.when(ms == F.lit(py), F.col("gwp"))).alias("py_gwp"),
        F.count(F.when(ms == F.lit(m), F.lit(1))).alias("_present"))
    plan_row = budget_total(plan.where(F.col("plan_month") == F.lit(m)), "plan_month", "plan_amount", "plan",
                            PLAN_METRICS, False)
    row = one_row(actual, plan_row).where(F.col("_present") > 0)
    gated = m.year == plan_year
    row = row.select(
        "month_start", *CORE,
        M.per_pet("nbw_gwp", "nbw_unique_pets", None).alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets", None).alias("avg_renewal_premium"),
        "prev_gwp", "py_gwp", *[f"plan_{s}" for _, s in PLAN_METRICS])
    row = row.select(
        "*",
        M.pct_change("gwp", "prev_gwp").alias("gwp_mom_pct"),
        M.pct_change("gwp", "py_gwp").alias("gwp_yoy_pct"),
        _vs_plan("gwp", "plan_gwp", gated).alias("gwp_vs_plan_pct"),
        _vs_plan("nbw_gwp", "plan_nbw_gwp", gated).alias("nbw_vs_plan_pct"),
        _vs_plan("renewal_gwp", "plan_renewal_gwp", gated).alias("renewal_vs_plan_pct"),
        _vs_plan("nbw_unique_pets", "plan_nbw_unique_pets", gated).alias("nbw_unique_pets_vs_plan_pct"),
        _vs_plan("renewal_unique_pets", "plan_renewal_unique_pets", gated).alias("renewal_unique_pets_vs_plan_pct"),
        _vs_plan("avg_nbw_premium", "plan_avg_nbw_premium", gated).alias("avg_nbw_vs_plan_pct"),
        _vs_plan("avg_renewal_premium", "plan_avg_renewal_premium", gated).alias("avg_renewal_vs_plan_pct"),
        _pet_share().alias("renewal_pet_share"),
        M.share("nbw_gwp", "gwp").alias("nbw_mix_pct"),
        M.share("renewal_gwp", "gwp").alias("renewal_mix_pct"))
    return M.as_output(row)


# Q7
def kpi_snapshot_range(fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period) -> DataFrame:
    """Range KPIs against plan and forecast. Actuals by day; plan and forecast by
    whole month (both bounds truncated to the month), so a partial month compares
    with its full-month plan. No plan-year gate."""
    actual = M.aggregate(period.filter(fact), None, M.core_measures())
    return range_snapshot_finish(actual, plan, forecast, period)


def range_snapshot_finish(actual: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period) -> DataFrame:
    """One row of core measures for the period -> the range snapshot with plan and forecast."""
    months = period.months()
    plan_row = budget_total(plan, "plan_month", "plan_amount", "plan", PLAN_METRICS[:5], True, months)
    fc_row = budget_total(forecast, "forecast_month", "forecast_amount", "forecast", PLAN_METRICS[:3], True, months)
    return range_snapshot_columns(one_row(actual, plan_row, fc_row))


def range_snapshot_columns(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Core measures, plan and forecast sums side by side -> the snapshot's columns, after any ``keys``."""
    # distinct counts of an empty period are 0 (a global aggregate's answer)
    row = row.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
                           for c in ("nbw_unique_pets", "renewal_unique_pets")})
    row = row.select(
        *(keys or []), *CORE,
        M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
        *[f"plan_{s}" for _, s in PLAN_METRICS[:5]],
        *[f"forecast_{s}" for _, s in PLAN_METRICS[:3]],
        M.pct_change("gwp", "plan_gwp").alias("gwp_vs_plan_pct"),
        M.pct_change("nbw_gwp", "plan_nbw_gwp").alias("nbw_vs_plan_pct"),
        M.pct_change("renewal_gwp", "plan_renewal_gwp").alias("renewal_vs_plan_pct"),
        M.pct_change("nbw_unique_pets", "plan_nbw_unique_pets").alias("nbw_unique_pets_vs_plan_pct"),
        M.pct_change("renewal_unique_pets", "plan_renewal_unique_pets").alias("renewal_unique_pets_vs_plan_pct"),
        _pet_share().alias("renewal_pet_share"),
        M.share("nbw_gwp", "gwp").alias("nbw_mix_pct"),
        M.share("renewal_gwp", "gwp").alias("renewal_mix_pct"),
        *[F.lit(None).cast("double").alias(c) for c in
          ("gwp_mom_pct", "gwp_yoy_pct", "avg_nbw_vs_plan_pct", "avg_renewal_vs_plan_pct")])
    return M.as_output(row)


# Q8
def ytd_snapshot(fact: DataFrame, plan: DataFrame, selected_month, plan_year: int) -> DataFrame:
    """Year-to-date through the month's end against the prior-year window (both
    bounds one year back, 29 Feb clamped) and the plan. One scan covers both years."""
    cur = Period.ytd(as_date(selected_month))
    py = cur.prior_year()
    src = fact.where(union_predicate(fact, [cur, py]))
    in_cur, in_py = cur.contains(), py.contains()
    measures = [
        M.SumOf("gwp", F.when(in_cur, F.col(M.AMOUNT))),
        M.SumOf("nbw_gwp", F.when(in_cur, M.amount_if(M.is_nbw()))),
        M.SumOf("renewal_gwp", F.when(in_cur, M.amount_if(M.is_renewal()))),
        M.DistinctPets("nbw_unique_pets", in_cur & M.is_nbw() & M.not_returned()),
        M.DistinctPets("renewal_unique_pets", in_cur & M.is_renewal() & M.not_returned()),
        M.SumOf("py_gwp", F.when(in_py, F.col(M.AMOUNT))),
        M.SumOf("py_nbw_gwp", F.when(in_py, M.amount_if(M.is_nbw()))),
        M.SumOf("py_renewal_gwp", F.when(in_py, M.amount_if(M.is_renewal()))),
    ]
    actual = M.aggregate(src, None, measures)
    plan_row = budget_total(plan, "plan_month", "plan_amount", "plan", PLAN_METRICS[:3], False, cur)
    row = one_row(actual, plan_row)
    gated = cur.end.year == plan_year
    row = row.select(
        *CORE,
        M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
        "py_gwp", "py_nbw_gwp", "py_renewal_gwp",
        "plan_gwp", "plan_nbw_gwp", "plan_renewal_gwp",
        M.pct_change("gwp", "py_gwp").alias("gwp_yoy_pct"),
        _vs_plan("gwp", "plan_gwp", gated).alias("gwp_vs_plan_pct"),
        _vs_plan("nbw_gwp", "plan_nbw_gwp", gated).alias("nbw_vs_plan_pct"),
        _vs_plan("renewal_gwp", "plan_renewal_gwp", gated).alias("renewal_vs_plan_pct"),
        _pet_share().alias("renewal_pet_share"))
    return M.as_output(row)


# Q25
def month_over_month(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Each month's GWP with the previous calendar month's GWP and the change.

    The previous month is looked up by date (a missing month gives null), through
    an equi-join of the monthly rows with themselves shifted one month; both sides
    hold one row per month.
    """
    if monthly is None:
        monthly = M.aggregate(fact, {"month_start": dimension("Month", fact)}, [M.SumOf("gwp", F.col(M.AMOUNT))])
    monthly = monthly.select("month_start", "gwp")
    prev = monthly.select(F.add_months("month_start", 1).alias("month_start"), F.col("gwp").alias("prev_gwp"))
    out = (monthly.join(prev, "month_start", "left")
           .select("month_start", "gwp", "prev_gwp", M.pct_change("gwp", "prev_gwp").alias("gwp_mom_pct"))
           .orderBy("month_start"))
    return M.as_output(out)
