"""Dimension registry: a dimension name resolves to a grouping column."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import PARTITION_COLUMN
from ..sources.written_details import resolve_vendor_column


def _month(df: DataFrame) -> Column:
    # The partition column equals trunc(report_date, 'month'); grouping by it reads no data column.
    return F.col(PARTITION_COLUMN) if PARTITION_COLUMN in df.columns else F.trunc("report_date", "month")


DIMENSIONS: dict[str, Callable[[DataFrame], Column]] = {
    "Week": lambda df: F.trunc("report_date", "week"),     # ISO week, Monday start
    "Month": _month,
    "State": lambda df: F.col("state"),
    "Channel": lambda df: F.col("iph_channel_5"),
    "Vendor": lambda df: F.col(resolve_vendor_column(df)),
    "Product": lambda df: F.col("product"),
}

# The drilldown dimensions, in the order the dashboard offers them.
DRILLDOWN_DIMENSIONS = ["Week", "State", "Channel", "Vendor", "Product"]


def dimension(name: str, df: DataFrame) -> Column:
    if name not in DIMENSIONS:
        raise ValueError(f"Invalid drilldown group: {name}")
    return DIMENSIONS[name](df)
