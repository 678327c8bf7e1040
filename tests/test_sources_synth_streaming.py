"""Sources (CSV by header name), calendar, generator and the streaming loader."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from premia.operators import synth as S
from premia.sources.calendar import dim_calendar
from premia.sources.schema import WRITTEN_DETAILS_COLUMNS
from premia.sources.written_details import SchemaError, read_written_details_csv, to_source_names


@pytest.fixture(scope="module")
def synth_fact(spark):
    return S.synth_written_details(spark, 3000, seed=7, num_partitions=3).cache()


def test_csv_binds_by_header_name(spark, synth_fact, tmp_path):
    src = to_source_names(synth_fact)
    cols = list(reversed(src.columns))  # reordered columns
    path = str(tmp_path / "csv")
    src.select(*[F.col(f"`{c}`") for c in cols]).write.option("header", True).csv(path)
    back = read_written_details_csv(spark, path)
    assert back.columns == [eng for _, eng, _ in WRITTEN_DETAILS_COLUMNS]
    assert back.count() == 3000
    # empty strings (blank channel, cancel code on non-cancels) load as null
    assert back.where(F.col("cancel_code").isNull()).count() == synth_fact.where(F.col("cancel_code") == "").count()
    assert back.exceptAll(synth_fact.replace("", None)).count() == 0


def test_csv_missing_column_and_path(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("x",)], "`Policy Number` string").write.option("header", True).csv(path)
    with pytest.raises(SchemaError):
        read_written_details_csv(spark, path)
    with pytest.raises(Exception):
        read_written_details_csv(spark, str(tmp_path / "missing"))


def test_calendar_default_range(spark):
    cal = dim_calendar(spark, "2024-01-01", "2026-12-31")
    assert cal.count() == 1096
    r = cal.where(F.col("date") == dt.date(2024, 2, 29)).collect()[0]
    assert (r["week_start"], r["month_name"], r["quarter"], r["is_month_end"]) == (dt.date(2024, 2, 26), "February", "Q1", 1)


def test_generator_is_partition_independent(spark):
    a = S.synth_written_details(spark, 2000, seed=3, num_partitions=1)
    b = S.synth_written_details(spark, 2000, seed=3, num_partitions=5)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_generator_shape(synth_fact):
    s = synth_fact.agg(F.min("trans_date"), F.max("trans_date"),
                       F.sum(F.when(F.col("returned_pet") == 1, 1).otherwise(0)),
                       F.sum(F.when((F.col("returned_pet") == 1) & (F.col("trans_code") != "Cancel Policy Line"), 1)
                             .otherwise(0))).collect()[0]
    assert s[0] >= dt.date(2024, 1, 1) and s[1] <= dt.date(2026, 4, 30)
    assert s[2] > 0 and s[3] == 0  # returned only on cancels
    years = dict(synth_fact.groupBy(F.year("trans_date")).count().collect())
    assert years == {2024: 1140, 2025: 1260, 2026: 600}
    # cancels are minus amount x N(.35, .15): negative on average (a draw below 0 flips one)
    neg = synth_fact.where(F.col("trans_code") == "Cancel Policy Line").agg(F.avg("written_amount")).collect()[0][0]
    assert neg < 0


def test_plan_and_forecast_sizes(spark):
    plan, fc = S.plan_allocation(spark), S.forecast_allocation(spark)
    assert plan.count() == 6804 and fc.count() == 4536
    tot = plan.where("dimension_type = 'Total' and metric_name = 'GWP'").orderBy("plan_month").first()
    assert 52e6 * 0.9 < float(tot["plan_amount"]) < 52e6 * 1.2
    w = plan.where("metric_name = 'GWP' and plan_month = '2026-01-01'").groupBy("dimension_type") \
        .agg(F.sum("plan_amount").alias("s")).collect()
    totals = [float(r["s"]) for r in w]
    assert max(totals) / min(totals) < 1.05  # each dimension type splits the same total


def test_streaming_ingest_exactly_once(spark, synth_fact, tmp_path):
    from premia.streaming.ingest import ingest_available
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    src = to_source_names(synth_fact)
    src.limit(1000).write.option("header", True).csv(landing + "/chunk1")
    assert ingest_available(spark, landing + "/*", table, ckpt) == 1000
    src.subtract(src.limit(1000)).write.option("header", True).csv(landing + "/chunk2")
    n2 = ingest_available(spark, landing + "/*", table, ckpt)
    assert n2 == 2000
    assert ingest_available(spark, landing + "/*", table, ckpt) == 0  # nothing new: nothing twice
    assert spark.read.parquet(table).count() == 3000


def test_views_and_control_totals(spark):
    from premia.operators.quality import control_totals, load_check
    from premia.sources.fixture import load_tables
    from premia.sources.written_details import register_views
    from conftest import SF_SMALL
    t = load_tables(spark, SF_SMALL)
    register_views(t)
    n = spark.sql("select count(*) from fact_written_details").collect()[0][0]
    assert n == t.fact.count()
    v = spark.sql("select sum(row_count) from vw_monthly_premium_kpis").collect()[0][0]
    assert v == n
    counts = dict(control_totals(t.fact, t.plan, t.forecast, t.calendar).collect())
    assert counts["fact_written_details"] == n and counts["fact_plan"] == 588 and counts["fact_forecast"] == 392
    checks = {r["table_name"]: r["schema_ok"] for r in
              load_check(t.fact, t.plan, t.forecast, t.calendar, {"fact_plan": ["plan_month", "nope"]}).collect()}
    assert checks["fact_plan"] is False and checks["fact_forecast"] is True


def test_parameterised_sql_over_views(spark):
    from premia.sources.fixture import load_tables
    from premia.sources.written_details import register_views
    from premia.operators.rollup import growth_drivers
    from premia.plans.period import Period
    from conftest import SF_SMALL
    t = load_tables(spark, SF_SMALL)
    register_views(t)
    got = spark.sql(
        "select iph_channel_5, round(sum(written_amount), 2) as total_gwp from fact_written_details "
        "where report_date between :a and :b group by iph_channel_5",
        args={"a": dt.date(2001, 1, 1), "b": dt.date(2001, 5, 4)}).collect()
    want = growth_drivers(t.fact, Period("2001-01-01", "2001-05-04")).select("iph_channel_5", "total_gwp").collect()
    assert sorted((r[0], float(r[1])) for r in got) == sorted((r[0], r[1]) for r in want)


def test_api_from_csv_end_to_end(spark, synth_fact, tmp_path):
    from premia.api import PremiumAnalytics
    from premia.operators.synth import forecast_allocation, plan_allocation
    from premia.sources.sinks import write_csv
    write_csv(synth_fact, str(tmp_path / "fact"), source_names=True)
    plan_allocation(spark).write.option("header", True).csv(str(tmp_path / "plan"))
    forecast_allocation(spark).write.option("header", True).csv(str(tmp_path / "fc"))
    pa = PremiumAnalytics.from_csv(spark, str(tmp_path / "fact"), str(tmp_path / "plan"), str(tmp_path / "fc"))
    assert pa.fact.count() == 3000
    snap = pa.get_kpi_snapshot_range("2026-01-01", "2026-04-30").collect()[0]
    assert snap["gwp"] is not None and snap["plan_gwp"] > 0
    assert snap["forecast_gwp"] is None  # no forecast rows before May: SUM over nothing is null
    assert pa.get_plan_comparison().count() == 12
    assert pa.get_kpi_snapshot("2026-04-01").collect()[0]["gwp_vs_plan_pct"] is not None
    assert pa.refresh("2026-01-01", "2026-04-30").drilldown("Vendor").count() > 0
    counts, sources = pa.get_control_totals()
    assert dict(counts.collect())["fact_plan"] == 6804 and "vw_monthly_premium_kpis" in sources
    with pytest.raises(ValueError):
        pa.get_drilldown_table("2026-01-01", "2026-04-30", "Region")
    got = pa.sql(spark, "select count(*) from vw_monthly_premium_kpis where month_start >= :m",
                 m=dt.date(2026, 1, 1)).collect()[0][0]
    assert got == 5  # Jan-Apr plus early May: report dates lag transactions by up to 4 days
    before = pa.get_monthly_kpis().where("month_start = '2026-03-01'").collect()[0]["row_count"]
    pa.refresh_monthly_view(["2026-03-15"])
    after = pa.get_monthly_kpis().where("month_start = '2026-03-01'").collect()[0]["row_count"]
    assert after == before and pa.get_monthly_kpis().count() == pa.get_available_months().count()
