"""Rule-based classification columns (product, channel groupings, vendors, key).

Every rule is a ``when`` chain, so it stays inside whole-stage codegen. Raw channel
attributes may arrive as null (an empty CSV field loads as null); the rules were
written for empty strings, so inputs are read through ``coalesce(x, '')``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V


def _blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def derive_product(wellness: Column | str = "wellness", accident: Column | str = "accident") -> Column:
    w = F.col(wellness) if isinstance(wellness, str) else wellness
    a = F.col(accident) if isinstance(accident, str) else accident
    expr = None
    for (wv, av), label in V.PRODUCT_LABELS.items():
        cond = (w == wv) & (a == av)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr  # other combinations -> null


def map_channel_5(channel: Column | str = "channel") -> Column:
    ch = _blank(channel)
    expr = F.when(ch == "", V.CHANNEL5_BLANK)
    for raw, label in V.CHANNEL5_LABELS.items():
        expr = expr.when(ch == raw, label)
    return expr.otherwise(V.OTHER)


def map_channel_6(channel: Column | str = "channel", sub_channel: Column | str = "sub_channel") -> Column:
    ch, sub = _blank(channel), _blank(sub_channel)
    expr = (F.when(ch == "", V.CHANNEL6_BLANK)
            .when((ch == V.CH_DTC) & (sub == V.SUB_REFERRAL), V.CHANNEL6_REFERRED))
    for raw, label in V.CHANNEL6_LABELS.items():
        expr = expr.when(ch == raw, label)
    return expr.otherwise(V.OTHER)


def map_vendor_5(channel: Column | str = "channel", sub_channel: Column | str = "sub_channel",
                 hospital: Column | str = "hospital") -> Column:
    ch, sub, hosp = _blank(channel), _blank(sub_channel), _blank(hospital)
    return (F.when(ch == V.CH_VETERINARY, F.when(hosp != "", hosp).otherwise(V.VENDOR5_VET_DEFAULT))
            .when(ch == V.CH_AGGREGATOR, V.VENDOR5_AGGREGATOR)
            .when((ch == V.CH_DTC) & (sub == V.SUB_REFERRAL), V.VENDOR5_REFERRED)
            .when(ch == V.CH_EMPLOYEE_BENEFITS, V.VENDOR5_EMPLOYEE_BENEFITS)
            .when(ch == V.CH_PARTNER, V.VENDOR5_PARTNER)
            .otherwise(V.VENDOR5_DEFAULT))


def map_vendor_6(channel: Column | str = "channel", sub_channel: Column | str = "sub_channel",
                 hospital: Column | str = "hospital") -> Column:
    ch, sub, hosp = _blank(channel), _blank(sub_channel), _blank(hospital)
    return (F.when(ch == V.CH_VETERINARY, F.when(hosp != "", hosp).otherwise(V.VENDOR6_VET_DEFAULT))
            .when(ch == V.CH_AGGREGATOR, F.when(sub != "", sub).otherwise(V.VENDOR6_AGGREGATOR_DEFAULT))
            .when((ch == V.CH_DTC) & (sub == V.SUB_REFERRAL), V.VENDOR6_REFERRED)
            .when(ch == V.CH_DTC, V.VENDOR6_DTC)
            .when(ch == V.CH_EMPLOYEE_BENEFITS, V.VENDOR6_EMPLOYEE_BENEFITS)
            .when(ch == V.CH_PARTNER, V.VENDOR6_PARTNER)
            .otherwise(V.OTHER))


def channel_key(channel: Column | str = "channel", sub_channel: Column | str = "sub_channel",
                channel_type: Column | str = "channel_type", hospital: Column | str = "hospital") -> Column:
    ch = _blank(channel)
    return F.when(ch == "", V.CHANNEL_KEY_BLANK).otherwise(
        F.concat(ch, _blank(sub_channel), _blank(channel_type), _blank(hospital)))


def classify(df: DataFrame) -> DataFrame:
    """Add product, IPH channel (5)/(6), vendor (5)/(6) and the channel key."""
    cols = {
        "product": derive_product(),
        "iph_channel_5": map_channel_5(),
        "iph_channel_6": map_channel_6(),
        "vendor_5": map_vendor_5(),
        "vendor_6": map_vendor_6(),
    }
    if "channel_type" in df.columns:
        cols["channel_key"] = channel_key()
    return df.withColumns(cols)


def derive_flags(df: DataFrame) -> DataFrame:
    """Flags that follow from other columns: U/W combined from company, feline from
    species, month names and the by-name month match (year ignored)."""
    cols = {}
    if "company" in df.columns:
        cols["uw_combined"] = F.col("company")
    if "species" in df.columns:
        cols["feline"] = F.when(F.col("species") == "Cat", 1).otherwise(0)
    if "report_date" in df.columns:
        cols["report_month_name"] = F.date_format("report_date", "MMMM")
    if "first_start_date" in df.columns:
        cols["first_report_month_name"] = F.date_format("first_start_date", "MMMM")
    if "report_date" in df.columns and "first_start_date" in df.columns:
        cols["month_match"] = F.when(
            F.date_format("report_date", "MMMM") == F.date_format("first_start_date", "MMMM"), "Yes"
        ).otherwise("No")
    return df.withColumns(cols)
