"""Grouped reporting operators: month list, bounds, year split, monthly KPIs,
weekly performance, top states, mixes, drilldowns and growth drivers.

Every operator is a filter (period, pushed to the scan and pruning partitions),
one ``measures.aggregate`` and a projection. Shares of a total use a scalar
subquery over the grouped rows (one number computed by a distributed global
aggregate and handed to every task), never a cross join and never a window that
pulls all groups into one partition. Orderings follow the source semantics:
descending sorts put nulls first and break ties on the key, so a top-N is
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.dims import dimension
from ..plans.period import Period, union_predicate


def _desc_then_key(value: str, key: str) -> list[Column]:
    return [F.desc_nulls_first(value), F.asc_nulls_first(key)]


# Q1
def available_months(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Distinct report months; read from the monthly view when there is one."""
    months = (monthly.select("month_start") if monthly is not None
              else fact.select(dimension("Month", fact).alias("month_start")).distinct())
    return months.orderBy("month_start")


# Q2
def date_bounds(fact: DataFrame) -> DataFrame:
    return fact.agg(F.min("report_date").alias("min_date"), F.max("report_date").alias("max_date"))


# Q3
def year_split(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Rows and GWP per report year. From the monthly view the per-year totals are
    sums of exact monthly decimal sums and row counts (no fact scan)."""
    if monthly is not None:
        g = monthly.groupBy(F.year("month_start").alias("report_year")).agg(
            F.sum("row_count").alias("row_count"), F.round(F.sum("gwp"), 2).alias("total_gwp"))
    else:
        g = fact.groupBy(F.year("report_date").alias("report_year")).agg(
            F.count(F.lit(1)).alias("row_count"), F.round(F.sum(M.AMOUNT), 2).alias("total_gwp"))
    return M.as_output(g.orderBy("report_year"))


# Q4
def monthly_kpis(fact: DataFrame, period: Period | None = None, monthly: DataFrame | None = None) -> DataFrame:
    """One row per report month: core measures, unrounded average premiums, row count.

    ``monthly`` is the materialised monthly view (``operators.views``) when there
    is one; otherwise the months are aggregated from the fact here.
    """
    if monthly is None:
        src = period.filter(fact) if period else fact
        monthly = M.aggregate(src, {"month_start": dimension("Month", src)}, M.core_measures(row_count=True))
    return M.as_output(monthly.select(
        "month_start", "gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets",
        M.per_pet("nbw_gwp", "nbw_unique_pets", None).alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets", None).alias("avg_renewal_premium"),
        "row_count"))


# Q5
def monthly_trend(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    return monthly_kpis(fact, monthly=monthly).drop("row_count").orderBy("month_start")


# Q9 / Q10
WOW_COLUMNS = ["gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets"]


def weekly_performance(fact: DataFrame, period: Period) -> DataFrame:
    """Weeks (Monday labels) clipped to the period, with week-over-week change.

    The change is taken between consecutive *present* weeks. The window has no
    partition key on purpose: it runs after aggregation over at most one row per
    week of the period, a count bounded by the calendar, not by the data.
    """
    src = period.filter(fact)
    return weekly_finish(M.aggregate(src, {"week_start": dimension("Week", src)}, M.core_measures()))


def weekly_finish(g: DataFrame) -> DataFrame:
    """Weekly rows (week_start + core measures) -> averages, mixes, week-over-week change."""
    g = g.select(
        "week_start", *WOW_COLUMNS,
        M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
        M.ratio("nbw_gwp", "gwp").alias("nbw_mix_pct"),
        M.ratio("renewal_gwp", "gwp").alias("renewal_mix_pct"))
    w = Window.orderBy(F.asc_nulls_first("week_start"))
    g = g.select("*", *[M.step_change(c, F.lag(c).over(w)).alias(f"{c}_wow_pct") for c in WOW_COLUMNS])
    return M.as_output(g).orderBy(F.asc_nulls_first("week_start"))


def with_share(grouped: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Add ``value / sum(value)`` over all rows, rounded to 6 places.

    The total is a scalar subquery over the grouped rows. Its struct also takes the
    max of every other grouped column, so column pruning leaves the subquery's
    aggregation identical to the main one (``max`` cannot be simplified away) and
    Spark reuses the main query's shuffle for it (``ReusedExchange``) instead of
    scanning the fact a second time.
    """
    others = [F.max(c).alias(f"_k{i}") for i, c in enumerate(grouped.columns) if c != value]
    total = grouped.agg(F.struct(F.sum(value).alias("total"), *others).alias("t")).scalar()
    return grouped.withColumn(out, M.ratio(F.col(value), total.getField("total")))


# Q11 / Q12
def top_states(fact: DataFrame, period: Period, top_n: int = 10, with_prior_year: bool = True) -> DataFrame:
    """States by GWP in the period; share of all states' GWP; prior-year GWP and YoY.

    One scan covers the period and its prior-year twin; each state's two sums are
    conditional sums of that scan. A null state never matches a prior-year row
    (plain, not null-safe, key equality), so its prior value is taken as missing.
    """
    if with_prior_year:
        py = period.prior_year()
        src = fact.where(union_predicate(fact, [period, py]))
        in_cur, in_py = period.contains("report_date"), py.contains("report_date")
        g = (src.groupBy(F.col("state"))
             .agg(F.sum(F.when(in_cur, F.col(M.AMOUNT))).alias("current_gwp"),
                  F.sum(F.when(in_py, F.col(M.AMOUNT))).alias("py_raw"),
                  F.count(F.when(in_cur, F.lit(1))).alias("n_cur"))
             .where(F.col("n_cur") > 0)
             .withColumn("py_raw", F.when(F.col("state").isNotNull(), F.col("py_raw"))))
    else:
        src = period.filter(fact)
        g = src.groupBy(F.col("state")).agg(F.sum(M.AMOUNT).alias("current_gwp"))
    return top_states_finish(g, top_n, with_prior_year)


def top_states_finish(g: DataFrame, top_n: int, with_prior_year: bool) -> DataFrame:
    """State rows (state, current_gwp[, py_raw]) -> share, prior-year columns, top N."""
    g = with_share(g, "current_gwp")
    if with_prior_year:
        py0 = F.coalesce(F.col("py_raw"), F.lit(0))
        cols = [F.round(py0, 2).alias("py_gwp"),
                F.when(py0 == 0, F.lit(None)).otherwise(
                    M.ratio(F.col("current_gwp") - F.col("py_raw"), F.col("py_raw"))).alias("yoy_pct")]
    else:
        cols = [F.lit(None).cast("double").alias("py_gwp"), F.lit(None).cast("double").alias("yoy_pct")]
    out = (g.orderBy(*_desc_then_key("current_gwp", "state")).limit(top_n)
           .select("state", F.round("current_gwp", 2).alias("current_gwp"), *cols, "share_pct"))
    return M.as_output(out)


# Q13 - Q16
def mix(fact: DataFrame, period: Period, dim: str, name: str) -> DataFrame:
    """GWP by one dimension with each group's share of the total, largest first."""
    src = period.filter(fact)
    g = src.groupBy(dimension(dim, src).alias(name)).agg(F.sum(M.AMOUNT).alias("gwp"))
    return mix_finish(g, name)


def mix_finish(g: DataFrame, name: str) -> DataFrame:
    g = with_share(g, "gwp")
    out = (g.orderBy(*_desc_then_key("gwp", name))
           .select(name, F.round("gwp", 2).alias("gwp"), "share_pct"))
    return M.as_output(out)


def channel_mix(fact: DataFrame, period: Period) -> DataFrame:
    return mix(fact, period, "Channel", "iph_channel_5")


def product_mix(fact: DataFrame, period: Period) -> DataFrame:
    return mix(fact, period, "Product", "product")


# Q20
def drilldown(fact: DataFrame, period: Period, group_by: str) -> DataFrame:
    """Core measures by one dimension (Week, State, Channel, Vendor, Product)."""
    key = dimension(group_by, fact)  # raises on an unknown name before any work
    src = period.filter(fact)
    return drilldown_finish(M.aggregate(src, {"drilldown_group": key}, M.core_measures()))


def drilldown_finish(g: DataFrame) -> DataFrame:
    out = g.select(
        "drilldown_group",
        F.round("gwp", 2).alias("actual_gwp"),
        F.round("nbw_gwp", 2).alias("nbw_gwp"),
        F.round("renewal_gwp", 2).alias("renewal_gwp"),
        "nbw_unique_pets", "renewal_unique_pets",
        M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
    ).orderBy(*_desc_then_key("actual_gwp", "drilldown_group"))
    return M.as_output(out)


# Q21
def metric_drilldown(fact: DataFrame, period: Period, metric: str, group_by: str) -> DataFrame:
    """One metric (NBW, Renewal, else Total) by one dimension: GWP, unique pets,
    average premium and share of the metric's total.

    Groups without rows of the metric's code still appear, with GWP 0.
    """
    key = dimension(group_by, fact)
    src = period.filter(fact)
    return metric_finish(M.aggregate(src, {"drilldown_group": key}, M.metric_measures(metric)))


def metric_finish(g: DataFrame) -> DataFrame:
    """Rows (drilldown_group, gwp, unique_pets) -> average premium and share."""
    g = with_share(g, "gwp")
    out = g.select(
        "drilldown_group",
        F.round("gwp", 2).alias("gwp"),
        "unique_pets",
        M.per_pet("gwp", "unique_pets").alias("avg_premium"),
        "share_pct",
    ).orderBy(*_desc_then_key("gwp", "drilldown_group"))
    return M.as_output(out)


# Q22 / Q23
def growth_drivers(fact: DataFrame, period: Period) -> DataFrame:
    src = period.filter(fact)
    return growth_finish(M.aggregate(src, {"iph_channel_5": dimension("Channel", src)}, M.core_measures()))


def growth_finish(g: DataFrame) -> DataFrame:
    out = g.select(
        "iph_channel_5",
        F.round("gwp", 2).alias("total_gwp"),
        F.round("nbw_gwp", 2).alias("nbw_gwp"),
        F.round("renewal_gwp", 2).alias("renewal_gwp"),
        "nbw_unique_pets", "renewal_unique_pets",
        M.ratio("nbw_gwp", "gwp").alias("nbw_mix_pct"),
        M.ratio("renewal_gwp", "gwp").alias("renewal_mix_pct"),
    ).orderBy(*_desc_then_key("total_gwp", "iph_channel_5"))
    return M.as_output(out)


# Q20, all dimensions in one pass
def drilldown_all(fact: DataFrame, period: Period, group_bys: list[str] | None = None) -> DataFrame:
    """Every drilldown of a refresh in one scan: ``GROUPING SETS`` over the
    dimensions, the group label cast to text, and a ``dimension`` column naming
    the grouping. Distinct pet counts are per grouping set (never added across)."""
    from ..functions.dims import DRILLDOWN_DIMENSIONS
    names = group_bys or DRILLDOWN_DIMENSIONS
    src = period.filter(fact)
    keys = [f"_d{i}" for i in range(len(names))]
    g = M.aggregate_sets(src, {k: dimension(n, src).cast("string") for n, k in zip(names, keys)},
                         [[k] for k in keys], M.core_measures())
    n = len(keys)
    label = F.lit(None).cast("string")
    group = F.lit(None).cast("string")
    for i, name in enumerate(names):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # only key i is grouped
        label = F.when(F.col("gid") == gid, F.lit(name)).otherwise(label)
        group = F.when(F.col("gid") == gid, F.col(f"_d{i}")).otherwise(group)
    out = g.select(
        label.alias("dimension"), group.alias("drilldown_group"),
        F.round("gwp", 2).alias("actual_gwp"), F.round("nbw_gwp", 2).alias("nbw_gwp"),
        F.round("renewal_gwp", 2).alias("renewal_gwp"), "nbw_unique_pets", "renewal_unique_pets",
        M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
        M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
    ).orderBy("dimension", F.desc_nulls_first("actual_gwp"), F.asc_nulls_first("drilldown_group"))
    return M.as_output(out)
