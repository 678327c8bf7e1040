"""Display formatting as Column expressions (no Python UDFs).

``format_number`` rounds half to even on the double's exact value, as Python's
``format`` does, so ``$x,xxx``, ``x,xxx`` and ``x.x%`` render identically to the
source system's formatters; null renders as an em dash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V

# FIXED VALUES — which result columns get which display format.
DATE_COLUMNS = ["month_start", "week_start"]
CURRENCY_COLUMNS = [
    "actual_gwp", "actual_nbw_gwp", "actual_renewal_gwp",
    "plan_gwp", "plan_nbw_gwp", "plan_renewal_gwp",
    "forecast_gwp", "forecast_nbw_gwp", "forecast_renewal_gwp",
    "actual_plus_forecast_gwp", "actual_vs_plan_gwp",
    "gwp", "nbw_gwp", "renewal_gwp",
    "avg_nbw_premium", "avg_renewal_premium", "avg_premium",
    "total_gwp", "current_gwp", "py_gwp",
]
NUMBER_COLUMNS = [
    "actual_nbw_unique_pets", "actual_renewal_unique_pets",
    "plan_nbw_unique_pets", "plan_renewal_unique_pets",
    "forecast_nbw_unique_pets", "forecast_renewal_unique_pets",
    "nbw_unique_pets", "renewal_unique_pets",
    "unique_pets", "row_count",
]
PCT_COLUMNS = [
    "actual_vs_plan_pct", "share_pct", "nbw_mix_pct", "renewal_mix_pct", "yoy_pct",
    "gwp_wow_pct", "nbw_gwp_wow_pct", "renewal_gwp_wow_pct",
    "nbw_unique_pets_wow_pct", "renewal_unique_pets_wow_pct",
]
DATE_SHARE_THRESHOLD = 0.8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sql_name(x: Column | str) -> str | None:
    return "`" + x.replace("`", "``") + "`" if isinstance(x, str) else None


def _null_dash(x: Column | str, body: str, col_body) -> Column:
    """``body`` over ``CAST(x AS DOUBLE)``, or an em dash for null / NaN.

    With a column name the whole expression is one SQL text (one JVM call)."""
    name = _sql_name(x)
    if name:
        v = f"CAST({name} AS DOUBLE)"
        return F.expr(f"CASE WHEN {v} IS NULL OR isnan({v}) THEN '{V.NULL_DISPLAY}' ELSE {body.format(v=v)} END")
    c = _c(x).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(V.NULL_DISPLAY)).otherwise(col_body(c))


def fmt_number(x: Column | str) -> Column:
    """``x,xxx`` (no decimals); null -> em dash."""
    return _null_dash(x, "format_number({v}, 0)", lambda c: F.format_number(c, 0))


def fmt_currency(x: Column | str) -> Column:
    """``$x,xxx`` (negative: ``$-x,xxx``); null -> em dash."""
    return _null_dash(x, "concat('$', format_number({v}, 0))",
                      lambda c: F.concat(F.lit("$"), F.format_number(c, 0)))


def fmt_pct(x: Column | str) -> Column:
    """``x.x%`` of a ratio (no thousands separator); null -> em dash."""
    return _null_dash(x, "concat(regexp_replace(format_number({v} * 100.0D, 1), ',', ''), '%')",
                      lambda c: F.concat(F.regexp_replace(F.format_number(c * F.lit(100.0), 1), ",", ""),
                                         F.lit("%")))


def plan_delta_label(x: Column | str) -> Column:
    return F.concat(F.lit(V.PLAN_DELTA_PREFIX), fmt_pct(x))


def fmt_date(x: Column | str) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd")


def week_label(x: Column | str) -> Column:
    """``Jan 8, 2001`` (abbreviated month, day without leading zero)."""
    return F.date_format(_c(x), "MMM d, yyyy")


def month_display(x: Column | str) -> Column:
    """``January 2001``."""
    return F.date_format(_c(x), "MMMM yyyy")


# Patterns tried for date text, in order of preference; the first takes ISO dates and timestamps.
DATE_PATTERNS = [None, "M/d/yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyyMMdd"]


def parse_dates(col: Column | str, pattern: str | None) -> Column:
    """Text as a date by one pattern; null where it doesn't parse."""
    text = _c(col).cast("string")
    return F.try_to_date(text) if pattern is None else F.try_to_date(text, pattern)


def date_shares(df: DataFrame, col: str) -> DataFrame:
    """One row, one scan: ``shares``, the parsed fraction of all rows by each of ``DATE_PATTERNS``."""
    return df.agg(F.array(*[F.avg(parse_dates(col, p).isNotNull().cast("double")) for p in DATE_PATTERNS]).alias("shares"))


def best_pattern(shares: Column) -> Column:
    """Place of the pattern that parses most rows, the first of equals."""
    return F.array_position(shares, F.array_max(shares)).cast("int")


def by_pattern(col: Column | str, place: Column) -> Column:
    """The date by the pattern at a place (from 1) of ``DATE_PATTERNS``."""
    out = F.lit(None).cast("date")
    for i, p in reversed(list(enumerate(DATE_PATTERNS, 1))):
        out = F.when(place == i, parse_dates(col, p)).otherwise(out)
    return out


def date_share(df: DataFrame, col: str) -> DataFrame:
    """One row: the fraction of rows that parse as dates by the best pattern (X8)."""
    return date_shares(df, col).select(F.array_max("shares").alias("date_share"))


def parse_date_column(df: DataFrame, col: str, threshold: float | None = None) -> DataFrame:
    """``df`` with a text column turned into dates by its best pattern if more than ``threshold`` of it parses."""
    limit = DATE_SHARE_THRESHOLD if threshold is None else threshold
    shares = date_shares(df, col).scalar()
    place = F.when(F.array_max(shares) > limit, best_pattern(shares))
    return df.withColumn(col, F.when(place.isNotNull(), F.date_format(by_pattern(col, place), "yyyy-MM-dd")).otherwise(
        F.col(col).cast("string")))


def format_report(df: DataFrame) -> DataFrame:
    """Format the known date / currency / count / percent columns; keep others.

    ``drilldown_group`` is shown as ``yyyy-MM-dd`` when more than 80% of its values
    parse as dates by one of ``DATE_PATTERNS``, else as text (a null group as ``None``). For a text column the share is a distributed
    global aggregate used through a scalar subquery (no value reaches the driver).
    """
    cols = {}
    for c in DATE_COLUMNS:
        if c in df.columns:
            cols[c] = fmt_date(F.col(c).cast("date"))
    if "drilldown_group" in df.columns:
        if isinstance(df.schema["drilldown_group"].dataType, T.DateType):
            # every value of a date column parses, and both branches render a date
            # as yyyy-MM-dd: no detection pass is needed
            cols["drilldown_group"] = F.date_format("drilldown_group", "yyyy-MM-dd")
        else:
            as_text = F.col("drilldown_group").cast("string")
            tried = F.array(*[F.avg(parse_dates("drilldown_group", p).isNotNull().cast("double")) for p in DATE_PATTERNS])
            # The struct also takes the max of every column so that the subquery's
            # plan equals the main one and Spark reuses its shuffle (one scan).
            others = [F.max(c).alias(f"_k{i}") for i, c in enumerate(df.columns)]
            shares = df.agg(F.struct(tried.alias("shares"), *others).alias("t")).scalar().getField("shares")
            parsed = by_pattern("drilldown_group", best_pattern(shares))
            cols["drilldown_group"] = F.when(F.array_max(shares) > F.lit(DATE_SHARE_THRESHOLD),
                                             F.date_format(parsed, "yyyy-MM-dd")).otherwise(F.coalesce(as_text, F.lit("None")))
    for c in CURRENCY_COLUMNS:
        if c in df.columns:
            cols[c] = fmt_currency(c)
    for c in NUMBER_COLUMNS:
        if c in df.columns:
            cols[c] = fmt_number(c)
    for c in PCT_COLUMNS:
        if c in df.columns:
            cols[c] = fmt_pct(c)
    return df.withColumns(cols) if cols else df


def is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)
