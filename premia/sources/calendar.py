"""Daily calendar dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _calendar_columns(days: DataFrame) -> DataFrame:
    d = F.col("date")
    return days.select(
        d.alias("date"),
        F.trunc(d, "week").alias("week_start"),
        F.trunc(d, "month").alias("month_start"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.month(d).alias("month_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.year(d).alias("year"),
        F.when(d == F.last_day(d), 1).otherwise(0).alias("is_month_end"),
    )


def dim_calendar(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive (Monday-start weeks)."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("date"))
    return _calendar_columns(days)


def calendar_from_fact(fact: DataFrame, date_col: str = "report_date") -> DataFrame:
    """Calendar covering whole years of the fact's report dates.

    The bounds are one distributed global aggregate; the exploded range is bounded
    by the number of days spanned, not by the number of fact rows.
    """
    bounds = fact.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    days = bounds.where(F.col("lo").isNotNull()).select(F.explode(F.sequence(
        F.make_date(F.year("lo"), F.lit(1), F.lit(1)),
        F.make_date(F.year("hi"), F.lit(12), F.lit(31)))).alias("date"))
    return _calendar_columns(days)
