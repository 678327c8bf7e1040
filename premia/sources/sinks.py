"""Sinks: partitioned Parquet tables, distributed CSV, and single-file report CSV."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from .written_details import to_source_names


def report_file_name(label: str, start: str | dt.date, end: str | dt.date, group: str | None = None) -> str:
    """``{label}[_{group}]_{start}_to_{end}`` — the name a downloaded report carries."""
    g = f"_{group.lower()}" if group else ""
    return f"{label}{g}_{start}_to_{end}"


def write_report_csv(result: DataFrame, path: str) -> None:
    """One CSV file with a header for an aggregated report.

    ``coalesce(1)`` funnels rows into one writer task, so this is for report-sized
    results (grouped rows, at most one per group), never for the fact itself.
    """
    result.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, source_names: bool = False, compression: str = "none") -> None:
    """Distributed CSV (one part file per task), header on every part; the
    reader binds columns by header name, so part order does not matter."""
    out = to_source_names(df) if source_names else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
