"""Typed schemas of the four source tables.

Source column names (with spaces, ``/``, parentheses, quotes) are kept only at the
I/O edge; inside the engine every column has a snake_case name.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# FIXED VALUES — written-details source columns in table order:
# (source name, engine name, type).
WRITTEN_DETAILS_COLUMNS = [
    ("Policy Number", "policy_number", T.StringType()),
    ("Campaign Code", "campaign_code", T.StringType()),
    ("Campaign Owner", "campaign_owner", T.StringType()),
    ("Pet Line", "pet_line", T.StringType()),
    ("TRANS DATE", "trans_date", T.DateType()),
    ("TRANS CODE", "trans_code", T.StringType()),
    ("CANCEL CODE", "cancel_code", T.StringType()),
    ("First Start Date", "first_start_date", T.DateType()),
    ("Cover Start Date", "cover_start_date", T.DateType()),
    ("Cover End Date", "cover_end_date", T.DateType()),
    ("Company", "company", T.StringType()),
    ("U/W Combined", "uw_combined", T.StringType()),
    ("State", "state", T.StringType()),
    ("Written Amount", "written_amount", MONEY),
    ("Earned Premium", "earned_premium", MONEY),
    ("Species", "species", T.StringType()),
    ("Enrollment Age", "enrollment_age", T.DecimalType(10, 2)),
    ("Base Plan", "base_plan", T.StringType()),
    ("Policy Limit", "policy_limit", T.StringType()),
    ("Limit Type", "limit_type", T.StringType()),
    ("Wellness", "wellness", T.IntegerType()),
    ("Accident", "accident", T.IntegerType()),
    ("Cancer", "cancer", T.IntegerType()),
    ("Feline", "feline", T.IntegerType()),
    ("Exam Fees", "exam_fees", T.IntegerType()),
    ("Prescriptions", "prescriptions", T.IntegerType()),
    ("PT/Rehab", "pt_rehab", T.IntegerType()),
    ("Holistic", "holistic", T.IntegerType()),
    ("RAC", "rac", T.IntegerType()),
    ("Pet ID", "pet_id", T.StringType()),
    ("Channel", "channel", T.StringType()),
    ("Sub Channel", "sub_channel", T.StringType()),
    ("Channel Type", "channel_type", T.StringType()),
    ("Hospital Affiliate Name", "hospital", T.StringType()),
    ("Returned Pet", "returned_pet", T.IntegerType()),
    ("Report Date", "report_date", T.DateType()),
    ("'Report Date' Month", "report_month_name", T.StringType()),
    ("'First Report Date' Month", "first_report_month_name", T.StringType()),
    ("Match", "month_match", T.StringType()),
    ("Concatenate", "channel_key", T.StringType()),
    ("PRODUCT", "product", T.StringType()),
    ("IPH Channel (5)", "iph_channel_5", T.StringType()),
    ("IPH Channel (6)", "iph_channel_6", T.StringType()),
    ("Vendor (5)", "vendor_5", T.StringType()),
    ("Vendor (6)", "vendor_6", T.StringType()),
]

SOURCE_TO_ENGINE = {src: eng for src, eng, _ in WRITTEN_DETAILS_COLUMNS}
ENGINE_TO_SOURCE = {eng: src for src, eng, _ in WRITTEN_DETAILS_COLUMNS}


def written_details_schema(names: str = "engine") -> T.StructType:
    idx = 1 if names == "engine" else 0
    return T.StructType([T.StructField(c[idx], c[2], True) for c in WRITTEN_DETAILS_COLUMNS])


PLAN_SCHEMA = T.StructType([
    T.StructField("plan_month", T.DateType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("dimension_type", T.StringType()),
    T.StructField("dimension_value", T.StringType()),
    T.StructField("plan_amount", MONEY),
])

FORECAST_SCHEMA = T.StructType([
    T.StructField("forecast_month", T.DateType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("dimension_type", T.StringType()),
    T.StructField("dimension_value", T.StringType()),
    T.StructField("forecast_amount", MONEY),
])

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("week_start", T.DateType()),
    T.StructField("month_start", T.DateType()),
    T.StructField("month_name", T.StringType()),
    T.StructField("month_number", T.IntegerType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("is_month_end", T.IntegerType()),
])

# The partition column added when the fact is written (first day of the report month).
PARTITION_COLUMN = "report_month"
