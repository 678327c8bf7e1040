"""Reporting periods: date ranges, months, year-to-date, prior-year shifts.

Bounds are computed on the driver from parameters (never from data) and enter the
plan as literals, so the date predicate is pushed to the Parquet scan and, when the
fact is partitioned by report month, a month-range conjunct prunes partitions.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import PARTITION_COLUMN


def as_date(x: str | dt.date) -> dt.date:
    if isinstance(x, dt.datetime):
        return x.date()
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def month_end(d: dt.date) -> dt.date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def add_months(d: dt.date, n: int) -> dt.date:
    """Calendar month shift with end-of-month clamping (31 Mar - 1 month = 28/29 Feb)."""
    y, m = divmod(d.month - 1 + n, 12)
    y += d.year
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def add_years(d: dt.date, n: int) -> dt.date:
    return add_months(d, 12 * n)


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date

    def __post_init__(self):
        object.__setattr__(self, "start", as_date(self.start))
        object.__setattr__(self, "end", as_date(self.end))

    # -- constructors -------------------------------------------------------
    @staticmethod
    def range(start, end, check: bool = True) -> "Period":
        p = Period(start, end)
        if check and p.start > p.end:
            raise ValueError("Start Date cannot be after End Date.")
        return p

    @staticmethod
    def month(m) -> "Period":
        m = month_start(as_date(m))
        return Period(m, month_end(m))

    @staticmethod
    def ytd(m) -> "Period":
        """1 January of the month's year through the month's last day."""
        m = as_date(m)
        return Period(dt.date(m.year, 1, 1), month_end(m))

    # -- derived periods ------------------------------------------------------
    def prior_year(self) -> "Period":
        """Both bounds shifted one year back, clamping 29 Feb to 28 Feb."""
        return Period(add_years(self.start, -1), add_years(self.end, -1))

    def months(self) -> "Period":
        """Month grain: both bounds truncated to the first of their month."""
        return Period(month_start(self.start), month_start(self.end))

    # -- predicates -------------------------------------------------------------
    def contains(self, col: str | Column = "report_date") -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return c.between(F.lit(self.start), F.lit(self.end))

    def predicate(self, df: DataFrame, date_col: str = "report_date") -> Column:
        """Inclusive date-range predicate, plus the partition-pruning conjunct."""
        cond = self.contains(date_col)
        if PARTITION_COLUMN in df.columns and date_col == "report_date":
            cond = cond & F.col(PARTITION_COLUMN).between(F.lit(month_start(self.start)),
                                                          F.lit(month_start(self.end)))
        return cond

    def filter(self, df: DataFrame, date_col: str = "report_date") -> DataFrame:
        return df.where(self.predicate(df, date_col))


def union_predicate(df: DataFrame, periods: list[Period], date_col: str = "report_date") -> Column:
    cond = None
    for p in periods:
        c = p.predicate(df, date_col)
        cond = c if cond is None else (cond | c)
    return cond
