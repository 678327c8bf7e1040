"""Load, append, refresh and reload keep every row, under the settings of the shipped session."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from premia.api import PremiumAnalytics
from premia.operators.views import FreshMonthlyView, monthly_rollup
from premia.operators.synth import forecast_allocation, plan_allocation
from premia.sources.schema import WRITTEN_DETAILS_COLUMNS
from premia.sources.sinks import write_csv
from premia.sources.written_details import SchemaError, read_budget_csv, read_fact, read_written_details_csv, write_fact
from premia.streaming.ingest import ingest_available
from conftest import CAN, NEW, REN, row

NAMES = [src for src, _, _ in WRITTEN_DETAILS_COLUMNS]
TYPES = {src: typ.simpleString() if hasattr(typ, "simpleString") else typ for src, _, typ in WRITTEN_DETAILS_COLUMNS}


@pytest.fixture(autouse=True)
def shipped_settings(spark):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    yield
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


@pytest.fixture
def facts(spark):
    from premia.operators.synth import synth_written_details
    return lambda n, seed: synth_written_details(spark, n, seed=seed)


def test_append_after_batch_load(spark, facts, tmp_path):
    table, landing, ckpt = (str(tmp_path / x) for x in ("fact", "landing", "ckpt"))
    write_fact(facts(2000, 1), table)
    write_csv(facts(300, 2), landing, source_names=True)
    assert ingest_available(spark, landing, table, ckpt) == 300
    assert read_fact(spark, table).count() == 2300
    assert ingest_available(spark, landing, table, ckpt) == 0
    assert read_fact(spark, table).count() == 2300


def test_rerun_of_a_staged_batch_adds_nothing(spark, facts, tmp_path):
    from premia.streaming.ingest import _Append
    table = str(tmp_path / "fact")
    batch = facts(50, 3)
    if "report_month" not in batch.columns:
        from pyspark.sql import functions as F
        batch = batch.withColumn("report_month", F.trunc("report_date", "month"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id":"one"}')
    append = _Append(table, str(tmp_path / "c"))
    append(batch, 0)
    append(batch, 0)
    assert append.rows == 50 and read_fact(spark, table).count() == 50


@pytest.mark.parametrize("emptied", [True, False])
def test_append_after_a_checkpoint_reset(spark, facts, tmp_path, emptied):
    """A new checkpoint at the old path hides no rows and loads no file again; a rerun adds nothing."""
    table, landing, ckpt = (str(tmp_path / x) for x in ("fact", "landing", "ckpt"))
    write_fact(facts(2000, 1), table)
    write_csv(facts(300, 2), landing, source_names=True)
    assert ingest_available(spark, landing, table, ckpt) == 300
    shutil.rmtree(ckpt)
    if emptied:
        landing = str(tmp_path / "landing2")
        write_csv(facts(500, 3), landing, source_names=True)
    else:
        more = str(tmp_path / "more")
        write_csv(facts(500, 3), more, source_names=True)
        for f in (tmp_path / "more").glob("part-*"):
            shutil.copy(f, landing)
    assert ingest_available(spark, landing, table, ckpt) == 500
    assert read_fact(spark, table).count() == 2800
    assert ingest_available(spark, landing, table, ckpt) == 0
    assert read_fact(spark, table).count() == 2800


def test_batch_of_other_files_is_an_error(spark, facts, tmp_path):
    from premia.streaming.ingest import FILE, _Append
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id":"one"}')
    batch = facts(20, 3).withColumn("report_month", F.trunc("report_date", "month"))
    with_file = lambda x: batch.withColumn(FILE, F.struct(
        F.lit(x).alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit(2).cast("long").alias("modified")))
    append = _Append(str(tmp_path / "fact"), str(tmp_path / "c"))
    append(with_file("a"), 0)
    append(with_file("a"), 0)
    with pytest.raises(RuntimeError, match="other files"):
        append(with_file("b"), 0)
    assert read_fact(spark, str(tmp_path / "fact")).count() == 20


def test_folder_with_two_column_orders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_rows(tmp_path / "in" / "a.csv", [csv_row() for _ in range(3)])
    write_rows(tmp_path / "in" / "b.csv", [csv_row() for _ in range(4)], names=NAMES[::-1])
    write_rows(tmp_path / "in" / "c.csv", [csv_row() for _ in range(5)], names=NAMES[::-1])
    got = read_written_details_csv(spark, str(tmp_path / "in"))
    dates = [e for s, e, _ in WRITTEN_DETAILS_COLUMNS if TYPES[s] == "date"]
    assert got.count() == 12 and got.where(f"{dates[0]} = date'2026-01-05'").count() == 12
    (tmp_path / "in" / "d.csv").write_text("x,y\n1,2\n")
    with pytest.raises(SchemaError, match="d.csv"):
        read_written_details_csv(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="(?i)PATH_NOT_FOUND|does not exist"):
        read_written_details_csv(spark, str(tmp_path / "none"))


def test_refresh_sees_appended_rows(spark, facts, tmp_path):
    src = {k: str(tmp_path / k) for k in ("fact", "plan", "fc", "landing", "ckpt")}
    write_csv(facts(2000, 1), src["fact"], source_names=True)
    plan_allocation(spark).write.option("header", True).csv(src["plan"])
    forecast_allocation(spark).write.option("header", True).csv(src["fc"])
    pa = PremiumAnalytics.from_csv(spark, src["fact"], src["plan"], src["fc"])
    write_csv(facts(500, 2), src["landing"], source_names=True)
    assert ingest_available(spark, src["landing"], pa.fact_path, src["ckpt"]) == 500
    assert pa.get_monthly_kpis().agg({"row_count": "sum"}).first()[0] == 2500
    whole = monthly_rollup(read_fact(spark, pa.fact_path)).orderBy("month_start").collect()
    assert pa.monthly.orderBy("month_start").select(*whole[0].asDict()).collect() == whole      # equals a rebuild
    counts, _ = pa.get_control_totals()
    assert dict(counts.collect())["fact_written_details"] == 2500


def test_view_counts_a_pet_of_both_loads_once(spark, make_fact, tmp_path):
    table = str(tmp_path / "fact")
    write_fact(make_fact([row("2025-01-05", NEW, 10, "A"), row("2025-01-09", REN, 5, None), row("2025-02-01", NEW, 7, "A")]), table)
    view = FreshMonthlyView(spark, table, str(tmp_path / "view"))
    first = view.read().orderBy("month_start").collect()
    assert [(r.row_count, r.nbw_unique_pets, r.renewal_unique_pets) for r in first] == [(2, 1, 0), (1, 1, 0)]
    assert not view.refresh()
    more = make_fact([row("2025-01-20", NEW, 1, "A"), row("2025-01-21", NEW, 2, "B"), row("2025-03-01", CAN, -3, "C")])
    more.withColumn("report_month", F.trunc("report_date", "month")).write.mode("append").partitionBy("report_month").parquet(table)
    got = view.read().orderBy("month_start").collect()
    want = monthly_rollup(read_fact(spark, table)).orderBy("month_start")
    assert got == view.read().sparkSession.createDataFrame(want.collect(), want.schema).select(*got[0].asDict()).collect()
    assert [(r.row_count, float(r.gwp), r.nbw_unique_pets) for r in got] == [(4, 18, 2), (1, 7, 1), (1, -3, 0)]
    write_fact(make_fact([row("2025-05-05", NEW, 10, "A")]), table)        # rewritten: rebuilt
    assert [(str(r.month_start), r.row_count) for r in view.read().collect()] == [("2025-05-01", 1)]


def test_reload_replaces_the_table(spark, facts, tmp_path):
    table = str(tmp_path / "fact")
    whole = facts(2000, 1)
    write_fact(whole, table)
    some = whole.where("report_date < date'2025-03-01'")
    n = some.count()
    assert 0 < n < 2000
    write_fact(some, table)
    assert read_fact(spark, table).count() == n


def csv_row(**values):
    base = {n: {"date": "2026-01-05"}.get(TYPES[n], "1" if TYPES[n] not in ("string",) else "x") for n in NAMES}
    base.update(values)
    return base


def write_rows(path, rows, names=NAMES):
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    path.write_text(",".join(names) + "\n" + "".join(",".join(quote(r[n]) for n in names) + "\n" for r in rows))


def test_quotes_and_line_ends_in_fields(spark, tmp_path):
    text = [n for n in NAMES if TYPES[n] == "string"]
    name = text[0]
    odd = ['The "Paw", Inc', "two\nlines", "plain, with comma"]
    write_rows(tmp_path / "a.csv", [csv_row(**{name: v}) for v in odd], names=NAMES[::-1])
    got = read_written_details_csv(spark, str(tmp_path / "a.csv"))
    engine = dict((s, e) for s, e, _ in WRITTEN_DETAILS_COLUMNS)
    assert sorted(r[0] for r in got.select(engine[name]).collect()) == sorted(odd)
    assert got.where(f"{engine[text[-1]]} = 'x'").count() == 3


def test_short_rows_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(NAMES) + "\nx,y,z\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_written_details_csv(spark, str(tmp_path / "a.csv")).collect()


def test_budget_binds_by_name_and_rejects_bad_values(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("metric_name,plan_amount,dimension_value,plan_month,dimension_type\nTotal,10.50,All,2026-01-01,Total\n")
    r = read_budget_csv(spark, str(good), "plan").first()
    assert r["plan_month"] == dt.date(2026, 1, 1) and r["metric_name"] == "Total" and float(r["plan_amount"]) == 10.5
    bad = tmp_path / "bad.csv"
    bad.write_text("metric_name,plan_amount,dimension_value,plan_month,dimension_type\nTotal,ten,All,2026-01-01,Total\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_budget_csv(spark, str(bad), "plan").collect()
    missing = tmp_path / "missing.csv"
    missing.write_text("metric_name,plan_month\nTotal,2026-01-01\n")
    with pytest.raises(SchemaError):
        read_budget_csv(spark, str(missing), "plan")
