"""User-facing API: the dashboard's queries as methods over loaded tables.

Each method returns a lazy DataFrame (``refresh``, ``periods`` and the context texts write
small tables first); nothing is collected. Loaded with ``from_csv``, the fact and the monthly
view are up to date whenever they are asked for: rows appended to the fact folder count. Dates are ISO strings
or ``datetime.date``. Year parameters replace the years the dashboard hard-codes.

    pa = PremiumAnalytics.from_csv(spark, "landing/written_details", plan_csv=..., forecast_csv=...)
    pa.get_weekly_performance_range("2026-01-01", "2026-04-30").show()
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .operators import budget as B
from .operators import kpi as K
from .operators import narrative as N
from .operators import quality as Q
from .operators import rollup as R
from .operators import transforms as X
from .operators.periods import PeriodReport
from .operators.refresh import RangeRefresh
from .operators.views import FreshMonthlyView
from .plans.period import Period, as_date
from .session import new_table_path
from .sources.calendar import calendar_from_fact
from .sources.written_details import read_budget_csv, read_fact, read_written_details_csv, write_fact


class PremiumAnalytics:
    def __init__(self, fact: DataFrame, plan: DataFrame, forecast: DataFrame, calendar: DataFrame | None = None,
                 monthly: DataFrame | None = None, plan_year: int = 2026, base_year: int = 2025,
                 trend_year: int = 2024, actuals_cutoff: int = 4):
        self._fact, self.plan, self.forecast = fact, plan, forecast
        self.calendar = calendar if calendar is not None else calendar_from_fact(fact)
        self._monthly, self.view, self.fact_path = monthly, None, None
        self.plan_year, self.base_year, self.trend_year = plan_year, base_year, trend_year
        self.actuals_cutoff = actuals_cutoff

    def _sync(self) -> None:
        """Takes in files appended to the fact folder since the last look."""
        if self.view is not None and (self.view.refresh() or self._monthly is None):
            spark = self._fact.sparkSession
            self._fact = read_fact(spark, self.fact_path, self._fact.schema)   # a new file list
            self._monthly = self.view.read()

    @property
    def fact(self) -> DataFrame:
        self._sync()
        return self._fact

    @property
    def monthly(self) -> DataFrame | None:
        self._sync()
        return self._monthly

    # -- construction --------------------------------------------------------------
    @classmethod
    def from_csv(cls, spark: SparkSession, fact_csv: str, plan_csv: str, forecast_csv: str,
                 calendar_csv: str | None = None, **years) -> "PremiumAnalytics":
        """Load the source CSVs (columns bound by header name), write the fact as
        partitioned Parquet and the monthly view to the shared folder, and read them."""
        fact = read_written_details_csv(spark, fact_csv)
        path = new_table_path(spark, "fact_written_details")
        write_fact(fact, path)
        fact = read_fact(spark, path)
        plan = read_budget_csv(spark, plan_csv, "plan")
        forecast = read_budget_csv(spark, forecast_csv, "forecast")
        calendar = read_budget_csv(spark, calendar_csv, "calendar") if calendar_csv else None
        pa = cls(fact, plan, forecast, calendar, **years)
        pa.view, pa.fact_path = FreshMonthlyView(spark, path, new_table_path(spark, "vw_monthly_premium_kpis")), path
        return pa

    def refresh_monthly_view(self, months: list | None = None) -> "PremiumAnalytics":
        """Brings fact and view up to date now; ``months`` need not be named, the appended files tell them."""
        if self.view is None:
            raise ValueError("No materialised monthly view: load with from_csv")
        self._sync()
        return self

    @classmethod
    def from_tables(cls, tables, **years) -> "PremiumAnalytics":
        return cls(tables.fact, tables.plan, tables.forecast, tables.calendar, tables.monthly, **years)

    # -- periods ---------------------------------------------------------------------
    def default_period(self, configured_start: str | dt.date | None = None) -> DataFrame:
        return X.default_period(R.date_bounds(self.fact), configured_start or f"{self.plan_year}-01-01")

    # -- queries -----------------------------------------------------------------------
    def get_available_months(self) -> DataFrame:
        return R.available_months(self.fact, self.monthly)

    def get_date_bounds(self) -> DataFrame:
        return R.date_bounds(self.fact)

    def get_year_split(self) -> DataFrame:
        return R.year_split(self.fact, self.monthly)

    def get_monthly_kpis(self) -> DataFrame:
        return R.monthly_kpis(self.fact, monthly=self.monthly)

    def get_nbw_renewal_trend(self) -> DataFrame:
        return R.monthly_trend(self.fact, self.monthly)

    def get_kpi_snapshot(self, selected_month) -> DataFrame:
        return K.kpi_snapshot_month(self.fact, self.plan, selected_month, self.plan_year, self.monthly)

    def get_kpi_snapshot_range(self, start_date, end_date) -> DataFrame:
        return K.kpi_snapshot_range(self.fact, self.plan, self.forecast, Period.range(start_date, end_date))

    def get_ytd_snapshot(self, selected_month) -> DataFrame:
        return K.ytd_snapshot(self.fact, self.plan, selected_month, self.plan_year)

    def get_weekly_performance(self, selected_month) -> DataFrame:
        return R.weekly_performance(self.fact, Period.month(selected_month))

    def get_weekly_performance_range(self, start_date, end_date) -> DataFrame:
        return R.weekly_performance(self.fact, Period.range(start_date, end_date))

    def get_top_states(self, selected_month, top_n: int = 10) -> DataFrame:
        return R.top_states(self.fact, Period.month(selected_month), top_n)

    def get_top_states_range(self, start_date, end_date, top_n: int = 10) -> DataFrame:
        return R.top_states(self.fact, Period.range(start_date, end_date), top_n, with_prior_year=False)

    def get_channel_mix(self, selected_month) -> DataFrame:
        return R.channel_mix(self.fact, Period.month(selected_month))

    def get_channel_mix_range(self, start_date, end_date) -> DataFrame:
        return R.channel_mix(self.fact, Period.range(start_date, end_date))

    def get_product_mix(self, selected_month) -> DataFrame:
        return R.product_mix(self.fact, Period.month(selected_month))

    def get_product_mix_range(self, start_date, end_date) -> DataFrame:
        return R.product_mix(self.fact, Period.range(start_date, end_date))

    def get_actual_forecast_vs_plan(self) -> DataFrame:
        return B.actual_forecast_vs_plan(self.fact, self.plan, self.forecast, self.plan_year, self.monthly)

    def get_actual_plan_forecast_range(self, start_date, end_date) -> DataFrame:
        return B.actual_plan_forecast_range(self.fact, self.plan, self.forecast, Period.range(start_date, end_date))

    def get_plan_comparison(self) -> DataFrame:
        return B.plan_comparison(self.fact, self.plan, self.forecast, self.base_year, self.plan_year, self.monthly)

    def get_drilldown_table(self, start_date, end_date, group_by: str) -> DataFrame:
        return R.drilldown(self.fact, Period.range(start_date, end_date), group_by)

    def get_nbw_renewal_drilldown_range(self, start_date, end_date, metric: str, group_by: str) -> DataFrame:
        return R.metric_drilldown(self.fact, Period.range(start_date, end_date), metric, group_by)

    def get_growth_drivers(self, selected_month) -> DataFrame:
        return R.growth_drivers(self.fact, Period.month(selected_month))

    def get_growth_drivers_range(self, start_date, end_date) -> DataFrame:
        return R.growth_drivers(self.fact, Period.range(start_date, end_date))

    def get_control_totals(self) -> tuple[DataFrame, list[str]]:
        return (Q.control_totals(self.fact, self.plan, self.forecast, self.calendar, self.monthly),
                list(Q.SOURCE_TABLES))

    # -- refresh, transforms and text ----------------------------------------------------
    def refresh(self, start_date, end_date) -> RangeRefresh:
        """All range results of a dashboard refresh from one grouping-sets scan."""
        return RangeRefresh(self.fact, self.plan, self.forecast, Period.range(start_date, end_date))

    def periods(self, periods: DataFrame) -> PeriodReport:
        """All range results for every row of ``periods(period_id, start_date, end_date)`` from one scan."""
        return PeriodReport(self.fact, self.plan, self.forecast, periods)

    def exec_trend(self) -> DataFrame:
        return X.exec_trend(self.get_nbw_renewal_trend(), self.get_actual_forecast_vs_plan(), self.trend_year,
                            self.base_year, self.plan_year, self.actuals_cutoff)

    def weekly_highlights(self, start_date, end_date) -> DataFrame:
        return X.weekly_highlights(self.get_weekly_performance_range(start_date, end_date))

    def trend_masked(self) -> DataFrame:
        return X.trend_masked(self.get_nbw_renewal_trend(), self.plan_year, self.actuals_cutoff)

    def ytd_compare(self, selected_month) -> DataFrame:
        return X.ytd_compare(self.get_ytd_snapshot(selected_month))

    def monthly_commentary(self) -> DataFrame:
        return N.monthly_commentary(self.fact, self.monthly)

    def commentary_context(self, start_date, end_date) -> DataFrame:
        p = Period.range(start_date, end_date)
        return N.commentary_context(self.fact, self.plan, self.forecast, p, as_date(end_date).strftime("%B %Y"))

    def assistant_context(self, start_date, end_date, questions=None) -> DataFrame:
        p = Period.range(start_date, end_date)
        return N.assistant_context(self.fact, self.plan, self.forecast, p, f"{p.start} to {p.end}",
                                   self.base_year, self.plan_year, questions, monthly=self.monthly)

    def sql(self, spark: SparkSession, text: str, **params) -> DataFrame:
        """Parameterised Spark SQL over the registered tables and the monthly view."""
        from .sources.written_details import register_views
        register_views(self)
        return spark.sql(text, args=params or None)
