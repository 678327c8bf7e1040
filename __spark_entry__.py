"""

Every registered query reads the driver's tables for ``sf_dir``; the engine's
written-details fact is derived from them once per session (see
``premia.sources.fixture.load_tables``) and the budget facts are the noise-free
allocation. Parameters are the standard fixture periods.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia import oracle as O
from premia.api import PremiumAnalytics
from premia.functions.dims import DRILLDOWN_DIMENSIONS
from premia.operators import budget as B
from premia.operators import kpi as K
from premia.operators import quality as Q
from premia.operators import narrative as N
from premia.operators import periods as PD
from premia.operators import rollup as R
from premia.operators import transforms as X
from premia.functions import classify as CL
from premia.functions import formats as FM
from premia.plans.period import Period
from premia.functions.ids import with_gapless_ids
from premia.functions.sql_functions import register_functions
from premia.operators.pet_bitmaps import PetBitmaps
from premia.operators.pet_buckets import PetBuckets
from premia.operators.views import FreshMonthlyView
from premia.session import new_table_path
from premia.sources import fixture as FX
from premia.sources.fixture import load_tables
from premia.sources.schema import PLAN_SCHEMA, WRITTEN_DETAILS_COLUMNS
from premia.sources.sinks import write_csv, write_report_csv
from premia.sources.written_details import read_budget_csv, read_fact, read_written_details_csv, write_fact
from premia.streaming.ingest import ingest_available

try:
    from premia.llm.queries import registry as _llm_registry
except ModuleNotFoundError as missing:     # only the subpackage itself may be absent
    if missing.name not in ("premia.llm", "premia.llm.queries"):
        raise
    _llm_registry = dict

SF_SMOKE = "/root/testdata/sf0.001"

FULL = Period(*FX.FULL_RANGE)
PARTIAL = Period(*FX.PARTIAL_RANGE)
EMPTY = Period(*FX.EMPTY_RANGE)
MONTH = FX.SELECTED_MONTH
METRICS = ["NBW", "Renewal", "Total"]


def _t(spark: SparkSession, sf_dir: str):
    return load_tables(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: weekly performance over the default dashboard range at sf0.001."""
    t = _t(spark, SF_SMOKE)
    return R.weekly_performance(t.fact, FULL)


def _registry() -> dict[str, tuple[Callable, str | None]]:
    return core_registry() | _llm_registry()


def core_registry() -> dict[str, tuple[Callable, str | None]]:
    """The metric queries, without those of the corpus subpackage."""
    reg: dict[str, tuple[Callable, str | None]] = {
        "available_months": (lambda s, d: R.available_months(_t(s, d).fact, _t(s, d).monthly),
                             O.q_available_months()),
        "date_bounds": (lambda s, d: R.date_bounds(_t(s, d).footers), O.q_date_bounds()),
        "year_split": (lambda s, d: R.year_split(_t(s, d).fact, _t(s, d).monthly), O.q_year_split()),
        "monthly_kpis": (lambda s, d: R.monthly_kpis(_t(s, d).fact, monthly=_t(s, d).monthly), O.q_monthly_kpis()),
        "monthly_trend": (lambda s, d: R.monthly_trend(_t(s, d).fact, _t(s, d).monthly), O.q_monthly_trend()),
        "kpi_snapshot_month": (
            lambda s, d: K.kpi_snapshot_month(_t(s, d).fact, _t(s, d).plan, MONTH, FX.PLAN_YEAR, _t(s, d).monthly),
            O.q_kpi_snapshot_month(MONTH, FX.PLAN_YEAR)),
        "kpi_snapshot_month_base_year": (
            lambda s, d: K.kpi_snapshot_month(_t(s, d).fact, _t(s, d).plan, "2000-04-01", FX.PLAN_YEAR, _t(s, d).monthly),
            O.q_kpi_snapshot_month("2000-04-01", FX.PLAN_YEAR)),
        "kpi_snapshot_range": (
            lambda s, d: K.kpi_snapshot_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL),
            O.q_kpi_snapshot_range(*FX.FULL_RANGE)),
        "kpi_snapshot_range_partial": (
            lambda s, d: K.kpi_snapshot_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, PARTIAL),
            O.q_kpi_snapshot_range(*FX.PARTIAL_RANGE)),
        "kpi_snapshot_range_empty": (
            lambda s, d: K.kpi_snapshot_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, EMPTY),
            O.q_kpi_snapshot_range(*FX.EMPTY_RANGE)),
        "ytd_snapshot": (
            lambda s, d: K.ytd_snapshot(_t(s, d).fact, _t(s, d).plan, MONTH, FX.PLAN_YEAR),
            O.q_ytd_snapshot(MONTH, FX.PLAN_YEAR)),
        "ytd_snapshot_leap": (
            lambda s, d: K.ytd_snapshot(_t(s, d).fact, _t(s, d).plan, FX.LEAP_MONTH, FX.PLAN_YEAR),
            O.q_ytd_snapshot(FX.LEAP_MONTH, FX.PLAN_YEAR)),
        "weekly_performance_month": (
            lambda s, d: R.weekly_performance(_t(s, d).fact, Period.month(MONTH)), O.q_weekly_month(MONTH)),
        "weekly_performance_range": (
            lambda s, d: R.weekly_performance(_t(s, d).fact, FULL), O.q_weekly_range(*FX.FULL_RANGE)),
        "weekly_performance_partial": (
            lambda s, d: R.weekly_performance(_t(s, d).fact, PARTIAL), O.q_weekly_range(*FX.PARTIAL_RANGE)),
        "top_states_month": (
            lambda s, d: R.top_states(_t(s, d).fact, Period.month(MONTH)), O.q_top_states_month(MONTH)),
        "top_states_range": (
            lambda s, d: R.top_states(_t(s, d).fact, FULL, with_prior_year=False),
            O.q_top_states_range(*FX.FULL_RANGE)),
        "channel_mix_month": (
            lambda s, d: R.channel_mix(_t(s, d).fact, Period.month(MONTH)), O.q_mix_month("iph_channel_5", MONTH)),
        "channel_mix_range": (
            lambda s, d: R.channel_mix(_t(s, d).fact, FULL), O.q_mix_range("iph_channel_5", *FX.FULL_RANGE)),
        "product_mix_month": (
            lambda s, d: R.product_mix(_t(s, d).fact, Period.month(MONTH)), O.q_mix_month("product", MONTH)),
        "product_mix_range": (
            lambda s, d: R.product_mix(_t(s, d).fact, FULL), O.q_mix_range("product", *FX.FULL_RANGE)),
        "actual_forecast_vs_plan": (
            lambda s, d: B.actual_forecast_vs_plan(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FX.PLAN_YEAR,
                                                   _t(s, d).monthly),
            O.q_actual_forecast_vs_plan(FX.PLAN_YEAR)),
        "actual_plan_forecast_range": (
            lambda s, d: B.actual_plan_forecast_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL),
            O.q_actual_plan_forecast_range(*FX.FULL_RANGE)),
        "actual_plan_forecast_partial": (
            lambda s, d: B.actual_plan_forecast_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, PARTIAL),
            O.q_actual_plan_forecast_range(*FX.PARTIAL_RANGE)),
        "plan_comparison": (
            lambda s, d: B.plan_comparison(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FX.BASE_YEAR,
                                           FX.PLAN_YEAR, _t(s, d).monthly),
            O.q_plan_comparison(FX.BASE_YEAR, FX.PLAN_YEAR)),
        "growth_drivers_month": (
            lambda s, d: R.growth_drivers(_t(s, d).fact, Period.month(MONTH)), O.q_growth_month(MONTH)),
        "growth_drivers_range": (
            lambda s, d: R.growth_drivers(_t(s, d).fact, FULL), O.q_growth_range(*FX.FULL_RANGE)),
        "control_totals": (
            lambda s, d: Q.control_totals(_t(s, d).footers, _t(s, d).plan, _t(s, d).forecast, _t(s, d).calendar,
                                         _t(s, d).monthly),
            O.q_control_totals()),
        "pct_change": (lambda s, d: K.month_over_month(_t(s, d).fact, _t(s, d).monthly), O.q_month_over_month()),
    }
    reg.update(_transforms())
    for dim in DRILLDOWN_DIMENSIONS:
        reg[f"drilldown_{dim.lower()}"] = (
            (lambda dim: lambda s, d: R.drilldown(_t(s, d).fact, FULL, dim))(dim),
            O.q_drilldown(dim, *FX.FULL_RANGE))
        for metric in METRICS:
            reg[f"metric_drilldown_{metric.lower()}_{dim.lower()}"] = (
                (lambda metric, dim: lambda s, d: R.metric_drilldown(_t(s, d).fact, FULL, metric, dim))(metric, dim),
                O.q_metric_drilldown(metric, dim, *FX.FULL_RANGE))
    return reg


DISPLAY = FULL.end.strftime("%B %Y")                 # commentary: the end month
ASSIST_DISPLAY = f"{FULL.start} to {FULL.end}"        # assistant: the analysis range


def _transforms() -> dict[str, tuple[Callable, str | None]]:
    P, B_, T_ = FX.PLAN_YEAR, FX.BASE_YEAR, FX.TREND_YEAR
    cut = FX.ACTUALS_CUTOFF_MONTH

    def afvp(s, d):
        t = _t(s, d)
        return B.actual_forecast_vs_plan(t.fact, t.plan, t.forecast, P, t.monthly)

    def comparison(s, d):
        t = _t(s, d)
        return B.plan_comparison(t.fact, t.plan, t.forecast, B_, P, t.monthly)

    reg = {
        "exec_trend": (lambda s, d: X.exec_trend(R.monthly_trend(_t(s, d).fact, _t(s, d).monthly), afvp(s, d),
                                                 T_, B_, P, cut),
                       O.q_exec_trend(T_, B_, P, cut)),
        "weekly_highlights": (lambda s, d: X.weekly_highlights(R.weekly_performance(_t(s, d).fact, FULL)),
                              O.q_weekly_highlights(*FX.FULL_RANGE)),
        "trend_masked": (lambda s, d: X.trend_masked(R.monthly_trend(_t(s, d).fact, _t(s, d).monthly), P, cut),
                         O.q_trend_masked(P, cut)),
        "ytd_compare": (lambda s, d: X.ytd_compare(K.ytd_snapshot(_t(s, d).fact, _t(s, d).plan, MONTH, P)),
                        O.q_ytd_compare(MONTH, P)),
        "top_growth_channels": (lambda s, d: X.top_growth_channels(R.growth_drivers(_t(s, d).fact, FULL)),
                                O.q_top_growth_channels(*FX.FULL_RANGE)),
        "full_year_totals": (lambda s, d: X.full_year_totals(comparison(s, d), B_, P), O.q_full_year_totals(B_, P)),
        "default_period": (lambda s, d: X.default_period(R.date_bounds(_t(s, d).fact), FX.FULL_RANGE[0]),
                           O.q_default_period(FX.FULL_RANGE[0])),
        "classification_summary": (
            lambda s, d: _t(s, d).fact.groupBy(
                "channel", "sub_channel", "wellness", "accident", "product", "iph_channel_5", "iph_channel_6",
                "vendor_5", "vendor_6", "channel_key").agg(F.count(F.lit(1)).alias("row_count")),
            O.q_classification_summary()),
        "dim_calendar": (lambda s, d: _t(s, d).calendar, O.q_dim_calendar()),
        "format_report_weekly": (
            lambda s, d: FM.format_report(R.weekly_performance(_t(s, d).fact, FULL)),
            O.q_format_report(O.q_weekly_range(*FX.FULL_RANGE), _WEEKLY_COLS)),
        "format_report_drilldown_week": (
            lambda s, d: FM.format_report(R.drilldown(_t(s, d).fact, FULL, "Week")),
            O.q_format_report(O.q_drilldown("Week", *FX.FULL_RANGE), _DRILL_COLS)),
        "format_report_drilldown_state": (
            lambda s, d: FM.format_report(R.drilldown(_t(s, d).fact, FULL, "State")),
            O.q_format_report(O.q_drilldown("State", *FX.FULL_RANGE), _DRILL_COLS)),
        "format_report_plan_range": (
            lambda s, d: FM.format_report(
                B.actual_plan_forecast_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL)),
            O.q_format_report(O.q_actual_plan_forecast_range(*FX.FULL_RANGE), _APF_COLS)),
        "commentary_text": (lambda s, d: N.monthly_commentary(_t(s, d).fact, _t(s, d).monthly),
                            O.q_monthly_commentary()),
        "commentary_context": (
            lambda s, d: N.commentary_context(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL, DISPLAY,
                                              refresh=_refresh(s, d)),
            O.q_commentary_context(*FX.FULL_RANGE, DISPLAY)),
        "assistant_context": (
            lambda s, d: N.assistant_context(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL, ASSIST_DISPLAY,
                                             B_, P, refresh=_refresh(s, d), monthly=_t(s, d).monthly),
            O.q_assistant_context(*FX.FULL_RANGE, ASSIST_DISPLAY, B_, P)),
    }
    classifiers = {
        "derive_product": ["wellness", "accident", "product"],
        "map_channel_5": ["channel", "iph_channel_5"],
        "map_channel_6": ["channel", "sub_channel", "iph_channel_6"],
        "map_vendor_5": ["channel", "sub_channel", "hospital", "vendor_5"],
        "map_vendor_6": ["channel", "sub_channel", "hospital", "vendor_6"],
        "channel_key": ["channel_key"],
    }
    for key, cols in classifiers.items():
        reg[key] = ((lambda cols: lambda s, d: _t(s, d).fact.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count")))(cols),
                    O.q_channel_key() if key == "channel_key" else O.q_classifier(cols))
    reg["derive_flags"] = (lambda s, d: _flags(_t(s, d).fact), O.q_derive_flags())
    refresh = {
        "refresh_kpi_snapshot_range": (lambda r: r.kpi_snapshot(), O.q_kpi_snapshot_range(*FX.FULL_RANGE)),
        "refresh_weekly_performance": (lambda r: r.weekly_performance(), O.q_weekly_range(*FX.FULL_RANGE)),
        "refresh_top_states": (lambda r: r.top_states(), O.q_top_states_range(*FX.FULL_RANGE)),
        "refresh_channel_mix": (lambda r: r.channel_mix(), O.q_mix_range("iph_channel_5", *FX.FULL_RANGE)),
        "refresh_product_mix": (lambda r: r.product_mix(), O.q_mix_range("product", *FX.FULL_RANGE)),
        "refresh_growth_drivers": (lambda r: r.growth_drivers(), O.q_growth_range(*FX.FULL_RANGE)),
        "refresh_drilldown_vendor": (lambda r: r.drilldown("Vendor"), O.q_drilldown("Vendor", *FX.FULL_RANGE)),
        "refresh_drilldown_week": (lambda r: r.drilldown("Week"), O.q_drilldown("Week", *FX.FULL_RANGE)),
        "refresh_metric_drilldown_total_state": (lambda r: r.metric_drilldown("Total", "State"),
                                                 O.q_metric_drilldown("Total", "State", *FX.FULL_RANGE)),
        "refresh_metric_drilldown_nbw_channel": (lambda r: r.metric_drilldown("NBW", "Channel"),
                                                 O.q_metric_drilldown("NBW", "Channel", *FX.FULL_RANGE)),
    }
    for key, (fn, sql) in refresh.items():
        reg[key] = ((lambda fn: lambda s, d: fn(_refresh(s, d)))(fn), sql)
    reg["drilldown_all_dimensions"] = (lambda s, d: R.drilldown_all(_t(s, d).fact, FULL),
                                       O.q_drilldown_all(*FX.FULL_RANGE))
    reg["detect_date_column"] = (
        lambda s, d: _detect(R.drilldown(_t(s, d).fact, FULL, "Week")),
        O.q_detect_date_column("Week", *FX.FULL_RANGE))
    reg["detect_date_column_state"] = (
        lambda s, d: _detect(R.drilldown(_t(s, d).fact, FULL, "State")),
        O.q_detect_date_column("State", *FX.FULL_RANGE))
    reg["value_formatters"] = (
        lambda s, d: _formatted_kpis(K.kpi_snapshot_range(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, FULL)),
        O.q_value_formatters(*FX.FULL_RANGE))
    reg["load_check"] = (
        lambda s, d: Q.load_check(_t(s, d).fact, _t(s, d).plan, _t(s, d).forecast, _t(s, d).calendar, _EXPECTED),
        O.q_load_check(_EXPECTED_COUNTS, _EXPECTED_OK))
    reg["detect_date_column_us"] = (lambda s, d: _detect(_weeks_as(s, d, "MM/dd/yyyy")),
                                    O.q_detect_date_text("%m/%d/%Y", *FX.FULL_RANGE))
    reg["detect_date_column_words"] = (lambda s, d: _detect(_weeks_as(s, d, "MMM d, yyyy")),
                                       O.q_detect_date_text("%b %-d, %Y", *FX.FULL_RANGE))
    reg["parse_date_column_us"] = (
        lambda s, d: FM.parse_date_column(_weeks_as(s, d, "MM/dd/yyyy"), "drilldown_group").select("drilldown_group", "actual_gwp"),
        O.q_week_text(*FX.FULL_RANGE))
    reg["sequence_ids"] = (
        lambda s, d: with_gapless_ids(_t(s, d).fact.select(*_ID_ORDER), [F.asc_nulls_first(c) for c in _ID_ORDER]).select(
            "id", *_ID_ORDER[:-1], F.col("written_amount").cast("double").alias("written_amount")),
        O.q_sequence_ids(_ID_ORDER))
    for dim in ("State", "Week", "Vendor"):
        reg[f"sql_drilldown_{dim.lower()}"] = ((lambda dim: lambda s, d: _sql(s, d, (
            f"SELECT * FROM drilldown(DATE'{FULL.start}', DATE'{FULL.end}', '{dim}')")))(dim),
            O.text_group(O.q_drilldown(dim, *FX.FULL_RANGE)))
    for metric in METRICS:
        reg[f"sql_metric_drilldown_{metric.lower()}_channel"] = ((lambda metric: lambda s, d: _sql(s, d, (
            f"SELECT * FROM metric_drilldown(DATE'{FULL.start}', DATE'{FULL.end}', '{metric}', 'Channel')")))(metric),
            O.q_metric_drilldown(metric, "Channel", *FX.FULL_RANGE))
    reg["sql_view_parameters"] = (
        lambda s, d: _analytics(s, d).sql(s, "SELECT * FROM vw_monthly_premium_kpis WHERE month_start BETWEEN :first AND :last",
                                          first=FULL.start, last=FULL.end),
        f"select * from ({O.q_monthly_kpis()}) where month_start between date '{FULL.start}' and date '{FULL.end}'")
    reg["bitmap_kpi_snapshot_range"] = (
        lambda s, d: _bitmaps(s, d).kpi_snapshot_range(_t(s, d).plan, _t(s, d).forecast, FULL), O.q_kpi_snapshot_range(*FX.FULL_RANGE))
    reg["bitmap_kpi_snapshot_partial"] = (
        lambda s, d: _bitmaps(s, d).kpi_snapshot_range(_t(s, d).plan, _t(s, d).forecast, PARTIAL),
        O.q_kpi_snapshot_range(*FX.PARTIAL_RANGE))
    for dim in ("Week", "State", "Channel", "Product"):
        reg[f"bitmap_drilldown_{dim.lower()}"] = ((lambda dim: lambda s, d: _bitmaps(s, d).drilldown(PARTIAL, dim))(dim),
                                                  O.q_drilldown(dim, *FX.PARTIAL_RANGE))
    for name, period in (("range", FULL), ("partial", PARTIAL), ("empty", EMPTY)):
        reg[f"buckets_kpi_snapshot_{name}"] = (
            (lambda p: lambda s, d: _buckets(s, d).kpi_snapshot_range(_t(s, d).plan, _t(s, d).forecast, p))(period),
            O.q_kpi_snapshot_range(period.start, period.end))
    for dim in ("Vendor", "State"):
        reg[f"buckets_drilldown_{dim.lower()}"] = ((lambda dim: lambda s, d: _buckets(s, d).drilldown(FULL, dim))(dim),
                                                   O.q_drilldown(dim, *FX.FULL_RANGE))
    reg["buckets_metric_drilldown_total_vendor"] = (lambda s, d: _buckets(s, d).metric_drilldown(PARTIAL, "Total", "Vendor"),
                                                    O.q_metric_drilldown("Total", "Vendor", *FX.PARTIAL_RANGE))
    loaded = {
        "csv_kpi_snapshot_range": (lambda f, p, t: K.kpi_snapshot_range(f, p, t.forecast, FULL), O.q_kpi_snapshot_range(*FX.FULL_RANGE)),
        "csv_actual_plan_forecast_range": (lambda f, p, t: B.actual_plan_forecast_range(f, p, t.forecast, FULL),
                                           O.q_actual_plan_forecast_range(*FX.FULL_RANGE)),
        "csv_monthly_kpis": (lambda f, p, t: R.monthly_kpis(f), O.q_monthly_kpis()),
        "csv_drilldown_state": (lambda f, p, t: R.drilldown(f, FULL, "State"), O.q_drilldown("State", *FX.FULL_RANGE)),
    }
    for key, (fn, sql) in loaded.items():
        reg[key] = ((lambda fn: lambda s, d: fn(*_from_csv(s, d), _t(s, d)))(fn), sql)
    reg["report_csv_drilldown_vendor"] = (_exported, O.q_drilldown("Vendor", *FX.FULL_RANGE))
    reg["stream_monthly_kpis"] = (lambda s, d: R.monthly_kpis(_streamed(s, d)), O.q_monthly_kpis())
    reg["stream_drilldown_channel"] = (lambda s, d: R.drilldown(_streamed(s, d), PARTIAL, "Channel"),
                                       O.q_drilldown("Channel", *FX.PARTIAL_RANGE))
    reg["monthly_kpis_after_append"] = (_appended_kpis, O.q_monthly_kpis())
    reg["kpi_snapshot_periods"] = (lambda s, d: _pairs(s, d).kpi_snapshots(), O.q_kpi_snapshot_pairs(*PAIR_MONTHS))
    ranged = {
        "kpi_snapshot_periods_odd": (lambda r: r.kpi_snapshots(), O.q_kpi_snapshot_range),
        "top_states_periods": (lambda r: r.top_states(), O.q_top_states_range),
        "channel_mix_periods": (lambda r: r.channel_mix(), lambda a, b: O.q_mix_range("iph_channel_5", a, b)),
        "product_mix_periods": (lambda r: r.product_mix(), lambda a, b: O.q_mix_range("product", a, b)),
        "weekly_performance_periods": (lambda r: r.weekly_performance(), O.q_weekly_range),
        "growth_drivers_periods": (lambda r: r.growth_drivers(), O.q_growth_range),
        "actual_plan_forecast_periods": (lambda r: r.actual_plan_forecast(), O.q_actual_plan_forecast_range),
        "commentary_context_periods": (
            lambda r: r.commentary_contexts(),
            lambda a, b: O.q_commentary_context(a, b, Period(a, b).end.strftime("%B %Y"))),
    }
    for kind in N.BLOCK_KINDS:
        ranged[f"top_n_lines_{kind}_periods"] = ((lambda kind: lambda r: r.block(kind))(kind),
                                                 (lambda kind: lambda a, b: O.block_sql(kind, a, b))(kind))
    for key, (fn, statement) in ranged.items():
        reg[key] = ((lambda fn: lambda s, d: fn(_ranges(s, d)))(fn), O.per_period(statement, RANGES))
    reg["assistant_context_periods"] = (_questions, O.per_period(
        lambda a, b: O.q_assistant_context(a, b, f"{a} to {b}", FX.BASE_YEAR, FX.PLAN_YEAR), RANGES))
    for kind in ["states", "channels", "products", "weeks", "growth"]:
        reg[f"top_n_lines_{kind}"] = (
            (lambda kind: lambda s, d: N.block(kind, _t(s, d).fact, FULL))(kind),
            O.block_sql(kind, *FX.FULL_RANGE))
    return reg


# A table of periods: every pair of months of two years; and ranges that overlap, repeat, nest, cut months or are empty.
PAIR_MONTHS = ("1999-05-01", "2001-04-01")
RANGES = [("full", *FX.FULL_RANGE), ("partial", *FX.PARTIAL_RANGE), ("same", *FX.PARTIAL_RANGE), ("day", "2001-03-14", "2001-03-14"),
          ("empty", *FX.EMPTY_RANGE), ("years", "1999-11-17", "2001-04-30"), ("month", "2000-02-01", "2000-02-29")]
_REPORTS: dict = {}


def _report(spark: SparkSession, sf_dir: str, name: str, periods: Callable[[], DataFrame]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _REPORTS:
        t = _t(spark, sf_dir)
        _REPORTS[key] = PD.PeriodReport(t.fact, t.plan, t.forecast, periods())
    return _REPORTS[key]


def _pairs(spark: SparkSession, sf_dir: str):
    return _report(spark, sf_dir, "pairs", lambda: PD.month_pairs(spark, *PAIR_MONTHS))


def _ranges(spark: SparkSession, sf_dir: str):
    return _report(spark, sf_dir, "ranges", lambda: spark.createDataFrame(
        RANGES, "period_id string, start_date string, end_date string"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question about every period."""
    t = _t(spark, sf_dir)
    asked = spark.createDataFrame([(i, *q) for i, _, _ in RANGES for q in N.ASSISTANT_QUESTIONS],
                                  "period_id string, assistant_type string, question string")
    years = FX.BASE_YEAR, FX.PLAN_YEAR
    return _ranges(spark, sf_dir).assistant_contexts(
        asked, B.plan_comparison(t.fact, t.plan, t.forecast, *years, t.monthly), *years)


_ID_ORDER = ["report_date", "policy_number", "pet_id", "trans_code", "written_amount"]


def _weeks_as(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """The weekly drilldown with its weeks as text of another date format."""
    weeks = R.drilldown(_t(spark, sf_dir).fact, FULL, "Week")
    return weeks.withColumn("drilldown_group", F.date_format("drilldown_group", pattern))


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    _t(spark, sf_dir).fact.createOrReplaceTempView("fact_written_details")
    register_functions(spark)
    return spark.sql(text)


def _analytics(spark: SparkSession, sf_dir: str) -> PremiumAnalytics:
    t = _t(spark, sf_dir)
    return PremiumAnalytics(t.fact, t.plan, t.forecast, t.calendar, plan_year=FX.PLAN_YEAR, base_year=FX.BASE_YEAR)


def _bitmaps(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir, "bitmaps")
    if key not in _REPORTS:
        _REPORTS[key] = PetBitmaps.build(_t(spark, sf_dir).fact)
    return _REPORTS[key]


def _buckets(spark: SparkSession, sf_dir: str) -> PetBuckets:
    key = (spark.sparkContext.applicationId, sf_dir, "buckets")
    if key not in _REPORTS:
        _REPORTS[key] = PetBuckets.build(_t(spark, sf_dir).fact)
    return _REPORTS[key]


def _appended_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly KPIs of a fact that comes in two loads, through a view that finds the appended files."""
    fact = _t(spark, sf_dir).fact
    path = new_table_path(spark, "fact_in_loads")
    view = FreshMonthlyView(spark, path, new_table_path(spark, "vw_monthly_fresh"))
    load = F.pmod(F.xxhash64("policy_number"), F.lit(2))
    for k in range(2):
        part = fact.where(load == k)
        if k == 0:
            write_fact(part, path)
        else:
            part.hint("rebalance", "report_month").write.mode("append").partitionBy("report_month").parquet(path)
        view.refresh()
    return R.monthly_kpis(fact, monthly=view.read())


def _halves(fact: DataFrame) -> list[DataFrame]:
    """The fact in two loads with all source columns; columns that it lacks are empty."""
    every = fact.select(*[F.col(c) if c in fact.columns else F.lit(None).cast(t).alias(c) for _, c, t in WRITTEN_DETAILS_COLUMNS])
    load = F.pmod(F.xxhash64("policy_number"), F.lit(2))
    return [every.where(load == k) for k in range(2)]


def _from_csv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fact and plan after a trip through CSV files, the fact's second load in another column order."""
    key = (spark.sparkContext.applicationId, sf_dir, "csv")
    if key not in _REPORTS:
        t, path = _t(spark, sf_dir), new_table_path(spark, "written_details_csv")
        for k, part in enumerate(_halves(t.fact)):
            write_csv(part.select(*part.columns[::1 - 2 * k]), f"{path}/load{k}", source_names=True, compression="gzip")
        table, plan = new_table_path(spark, "fact_from_csv"), new_table_path(spark, "plan_csv")
        write_fact(read_written_details_csv(spark, path), table)
        write_csv(t.plan.select(*PLAN_SCHEMA.fieldNames()[::-1]), plan)
        _REPORTS[key] = read_fact(spark, table), read_budget_csv(spark, plan, "plan")
    return _REPORTS[key]


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor drilldown as its report file gives it back."""
    report, path = R.drilldown(_t(spark, sf_dir).fact, FULL, "Vendor"), new_table_path(spark, "report")
    write_report_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).option("escape", '"').csv(path)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact from two chunks that a stream took in one after the other, the second from a new checkpoint."""
    key = (spark.sparkContext.applicationId, sf_dir, "stream")
    if key not in _REPORTS:
        landing, table = new_table_path(spark, "landing"), new_table_path(spark, "fact_streamed")
        for k, part in enumerate(_halves(_t(spark, sf_dir).fact)):
            write_csv(part, f"{landing}/chunk{k}", source_names=True, compression="gzip")
            ingest_available(spark, f"{landing}/*", table, new_table_path(spark, "ingest"))
        _REPORTS[key] = read_fact(spark, table)
    return _REPORTS[key]


_REFRESH: dict = {}


def _refresh(spark: SparkSession, sf_dir: str):
    """One single-scan refresh of the full range per session and test-data folder."""
    from premia.operators.refresh import RangeRefresh
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REFRESH:
        t = _t(spark, sf_dir)
        _REFRESH[key] = RangeRefresh(t.fact, t.plan, t.forecast, FULL)
    return _REFRESH[key]


def _flags(fact: DataFrame) -> DataFrame:
    """Flags of every row, with the hospital as company and the transaction date as first start date."""
    rows = fact.select("state", "species", "report_date", F.col("hospital").alias("company"),
                       F.col("trans_date").alias("first_start_date"))
    return CL.derive_flags(rows).groupBy(
        "state", "uw_combined", "feline", "report_month_name", "first_report_month_name", "month_match").agg(
        F.count(F.lit(1)).alias("row_count"))


def _detect(df: DataFrame) -> DataFrame:
    share = FM.date_share(df, "drilldown_group")
    return share.select("date_share", (F.col("date_share") > FM.DATE_SHARE_THRESHOLD).alias("is_date"))


def _formatted_kpis(k: DataFrame) -> DataFrame:
    cur = ["gwp", "nbw_gwp", "renewal_gwp", "avg_nbw_premium", "avg_renewal_premium"]
    num = ["nbw_unique_pets", "renewal_unique_pets"]
    pct = ["nbw_mix_pct", "renewal_mix_pct", "renewal_pet_share"]
    cols = ([FM.fmt_currency(c).alias(f"{c}_display") for c in cur]
            + [FM.fmt_number(c).alias(f"{c}_display") for c in num]
            + [FM.fmt_pct(c).alias(f"{c}_display") for c in pct]
            + [FM.plan_delta_label(c).alias(f"{c}_label")
               for c in ["gwp_vs_plan_pct", "nbw_vs_plan_pct", "renewal_vs_plan_pct"]])
    return k.select(*cols)


# Columns each engine table must carry for the operators (fixture fact: the mapped subset).
_EXPECTED = {
    "fact_written_details": {"report_date": "date", "trans_code": "string", "written_amount": "decimal(18,2)", "pet_id": "string",
                             "returned_pet": "int", "state": "string", "iph_channel_5": "string", "product": "string",
                             "vendor_5": "string", "report_month": "date"},
    "fact_plan": {"plan_month": "date", "metric_name": "string", "dimension_type": "string", "dimension_value": "string",
                  "plan_amount": "decimal(18,2)"},
    "fact_forecast": {"forecast_month": "date", "metric_name": "string", "dimension_type": "string",
                      "dimension_value": "string", "forecast_amount": "decimal(18,2)"},
    "dim_calendar": {"date": "date", "week_start": "date", "month_start": "date", "month_name": "string", "month_number": "int",
                     "quarter": "string", "year": "int", "is_month_end": "int"},
}
_EXPECTED_COUNTS = {"fact_written_details": 22,  # 15 mapped + channel_type + 5 classes + key + month
                    "fact_plan": 5, "fact_forecast": 5, "dim_calendar": 8}
_EXPECTED_OK = {k: True for k in _EXPECTED}

_WEEKLY_COLS = ["week_start", "gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets",
                "avg_nbw_premium", "avg_renewal_premium", "nbw_mix_pct", "renewal_mix_pct",
                "gwp_wow_pct", "nbw_gwp_wow_pct", "renewal_gwp_wow_pct", "nbw_unique_pets_wow_pct",
                "renewal_unique_pets_wow_pct"]
_DRILL_COLS = ["drilldown_group", "actual_gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets",
               "avg_nbw_premium", "avg_renewal_premium"]
_APF_COLS = ["month_start"] + [f"{k}_{s}" for k in ("actual", "plan", "forecast")
                               for s in ("gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets")] + \
    ["actual_plus_forecast_gwp", "actual_vs_plan_gwp", "actual_vs_plan_pct"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _registry().items() if v[1] is not None}
