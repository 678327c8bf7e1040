"""Control totals and load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — table names shown in the control totals, and the source list.
TABLE_NAMES = ["fact_written_details", "fact_plan", "fact_forecast", "dim_calendar"]
SOURCE_TABLES = ["fact_written_details", "fact_plan", "fact_forecast", "dim_calendar", "vw_monthly_premium_kpis"]


# Q24
def control_totals(fact: DataFrame, plan: DataFrame, forecast: DataFrame, calendar: DataFrame,
                   monthly: DataFrame | None = None) -> DataFrame:
    """Row count per table (UNION ALL of four global counts). The fact itself is counted,
    so a monthly view that disagrees with it shows; ``monthly`` is accepted and not read."""
    out = None
    for name, df in zip(TABLE_NAMES, [fact, plan, forecast, calendar]):
        c = df.agg(F.count(F.lit(1)).alias("row_count"))
        c = c.select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


# G13
def load_check(fact: DataFrame, plan: DataFrame, forecast: DataFrame, calendar: DataFrame,
               expected: dict[str, list[str] | dict[str, str]] | None = None) -> DataFrame:
    """Row counts plus whether each table carries its expected columns, with types if they are given."""
    frames = dict(zip(TABLE_NAMES, [fact, plan, forecast, calendar]))
    out = None
    for name, df in frames.items():
        want = (expected or {}).get(name)
        have = dict(df.dtypes)
        ok = all(c in have and (not isinstance(want, dict) or have[c] == want[c]) for c in want or [])
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(ok).alias("schema_ok"))
        out = c if out is None else out.unionByName(c)
    return out
