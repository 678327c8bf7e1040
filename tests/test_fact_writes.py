"""How the fact is written: whole rows are neither shuffled nor sorted wide, months stay together and sorted by date."""

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter

from conftest import FACT_SCHEMA, NEW, row
from premia.sources import written_details as W
from premia.sources.written_details import laid_out, read_fact, write_fact


def _mixed(spark, months=14, days=9):
    """Rows of all months in every partition, latest first, some without a date."""
    rows = [row(f"{2001 + m // 12}-{1 + m % 12:02}-{1 + d:02}", NEW, 10 + d, f"P{m}", state="" if d == 3 else "CA")
            for d in reversed(range(days)) for m in reversed(range(months))]
    rows += [(None, *row("2001-01-01", NEW, k, f"N{k}")[1:]) for k in range(3)]
    return spark.createDataFrame(rows, FACT_SCHEMA).repartition(4)


def _shuffles(spark):
    return spark.sparkContext._jsc.sc().newShuffleId()


def _files(spark, table):
    found = {}
    for r in read_fact(spark, table).selectExpr("_metadata.file_path as f", "report_month", "report_date").collect():
        found.setdefault(r.f, []).append((r.report_month, r.report_date))
    return found


def test_rows_are_placed_by_month_and_sorted_without_a_shuffle(spark, tmp_path):
    fact, table = _mixed(spark).localCheckpoint(), str(tmp_path / "the fact")
    before = _shuffles(spark)
    write_fact(fact, table)
    assert _shuffles(spark) == before + 1
    files = _files(spark, table)
    assert len(files) == 15                                     # one a month, and one of rows without a date
    assert all(len({m for m, _ in x}) == 1 and [d for _, d in x] == sorted((d for _, d in x), key=str) for x in files.values())
    back = read_fact(spark, table)
    assert sorted(back.columns) == sorted([*fact.columns, "report_month"])
    assert sorted(map(str, back.select(fact.columns).collect())) == sorted(map(str, fact.collect()))
    assert {r.report_month for r in back.where("report_date = '2001-02-05'").collect()} == {dt.date(2001, 2, 1)}
    assert [x.name for x in tmp_path.iterdir()] == ["the fact"]     # the dealt rows are gone


@pytest.mark.parametrize("limits", [(2, 512), (128, 3)])
def test_more_months_than_a_task_or_a_plan_takes(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(W, "OPEN_MONTHS", limits[0])
    monkeypatch.setattr(W, "MONTH_SCANS", limits[1])
    fact = _mixed(spark)
    write_fact(fact, str(tmp_path / "fact"))
    assert sorted(map(str, read_fact(spark, str(tmp_path / "fact")).select(fact.columns).collect())) == sorted(map(str, fact.collect()))


def test_a_large_month_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "GATHER_SETTINGS", W.GATHER_SETTINGS | {"spark.sql.files.maxPartitionBytes": "4k",
                                                                   "spark.sql.files.openCostInBytes": "1k"})
    fact = _mixed(spark, months=1, days=28)
    write_fact(fact, str(tmp_path / "fact"))
    assert len(_files(spark, str(tmp_path / "fact"))) > 2
    assert read_fact(spark, str(tmp_path / "fact")).count() == 31


def test_empty_fact_and_failing_rows(spark, tmp_path):
    fact = _mixed(spark)
    write_fact(fact.where("false"), str(tmp_path / "fact"))
    schema = laid_out(fact.selectExpr("*", "trunc(report_date, 'month') as report_month")).schema
    assert read_fact(spark, str(tmp_path / "fact"), schema).count() == 0
    with pytest.raises(Exception, match="wrong row"):
        write_fact(fact.withColumn("state", W.F.raise_error(W.F.lit("wrong row")).cast("string")), str(tmp_path / "fact"))
    assert [x.name for x in tmp_path.iterdir()] == ["fact"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"

def test_rows_dealt_by_month_are_not_sorted_first(spark, tmp_path, monkeypatch):
    seen, plain = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        seen.append((path, spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return plain(self, path, *a, **k)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    from premia.streaming.ingest import _Append
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id":"one"}')
    append = _Append(str(tmp_path / "fact"), str(tmp_path / "c"))
    append(_mixed(spark).selectExpr("*", "trunc(report_date, 'month') as report_month"), 0)
    assert seen == [(f"{tmp_path}/fact/_staged/one/0", "128")] and append.rows == 129
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
