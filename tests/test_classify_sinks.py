"""Classification rules on every branch (brute force in Python), derived flags, report CSV."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from premia.functions.classify import classify, derive_flags

CHANNELS = [None, "", "DTC", "Aggregator", "Veterinary", "Employee Benefits", "Partner", "Foo"]
SUBS = [None, "", "Referral Program", "Paid Search"]
HOSPITALS = [None, "", "Metro Vet Group"]


def expect(ch, sub, hosp):
    ch, sub, hosp = ch or "", sub or "", hosp or ""
    c5 = {"": "DTC (non-Aggs)", "DTC": "DTC", "Aggregator": "Aggregator", "Veterinary": "Vet",
          "Employee Benefits": "Employee Benefits", "Partner": "Partner"}.get(ch, "Other")
    if ch == "":
        c6 = "DTC (non-Aggs) - Add"
    elif ch == "DTC" and sub == "Referral Program":
        c6 = "Referred by Friend"
    else:
        c6 = {"DTC": "DTC Direct", "Aggregator": "Aggregator", "Veterinary": "Vet / All Other Vets",
              "Employee Benefits": "EB Direct Bill", "Partner": "Affinity / Partner"}.get(ch, "Other")
    if ch == "Veterinary":
        v5, v6 = hosp or "All Other Vets", hosp or "Vet / Other"
    elif ch == "Aggregator":
        v5, v6 = "Aggregator Marketplace", sub or "Aggregator"
    elif ch == "DTC" and sub == "Referral Program":
        v5 = v6 = "Referred by Friend"
    elif ch == "DTC":
        v5, v6 = "DTC / Other", "DTC"
    elif ch == "Employee Benefits":
        v5, v6 = "Employee Benefits", "EB Discount Sites"
    elif ch == "Partner":
        v5, v6 = "Partner Network", "Affinity Partner"
    else:
        v5, v6 = "DTC / Other", "Other"
    key = "DTC (non-Aggs) - Add" if ch == "" else f"{ch}{sub}T{hosp}"
    return c5, c6, v5, v6, key


def test_every_classification_branch(spark):
    rows = [(c, s, h, w, a) for (c, s, h), (w, a) in
            zip(itertools.product(CHANNELS, SUBS, HOSPITALS), itertools.cycle([(0, 0), (0, 1), (1, 0), (1, 1)]))]
    df = spark.createDataFrame(rows, "channel string, sub_channel string, hospital string, wellness int, accident int")
    out = classify(df.withColumn("channel_type", F.lit("T"))).collect()
    products = {(0, 0): "AI", (0, 1): "AO", (1, 0): "AI-WELL", (1, 1): "AO-WELL"}
    for r in out:
        assert (r["iph_channel_5"], r["iph_channel_6"], r["vendor_5"], r["vendor_6"], r["channel_key"]) == \
            expect(r["channel"], r["sub_channel"], r["hospital"])
        assert r["product"] == products[(r["wellness"], r["accident"])]


def test_derived_flags_match_by_month_name(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 2), dt.date(2025, 3, 30), "APIC", "Cat"),
                                (dt.date(2026, 3, 2), dt.date(2026, 2, 27), "IAIC", "Dog")],
                               "report_date date, first_start_date date, company string, species string")
    got = [tuple(r) for r in derive_flags(df).select("report_month_name", "first_report_month_name", "month_match",
                                                      "uw_combined", "feline").collect()]
    assert got == [("March", "March", "Yes", "APIC", 1), ("March", "February", "No", "IAIC", 0)]


def test_report_csv_single_file_and_name(spark, tmp_path):
    from premia.sources.sinks import report_file_name, write_report_csv
    name = report_file_name("executive_drilldown", "2026-01-01", "2026-04-30", group="Week")
    assert name == "executive_drilldown_week_2026-01-01_to_2026-04-30"
    df = spark.range(0, 100, numPartitions=4).withColumnRenamed("id", "x")
    write_report_csv(df, str(tmp_path / name))
    parts = [p for p in (tmp_path / name).iterdir() if p.name.endswith(".csv")]
    assert len(parts) == 1
    lines = parts[0].read_text().splitlines()
    assert lines[0] == "x" and len(lines) == 101
