"""Readers and writers of the written-details fact and the budget facts."""

from __future__ import annotations

import contextlib
import csv
import functools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from .schema import (CALENDAR_SCHEMA, FORECAST_SCHEMA, PARTITION_COLUMN, PLAN_SCHEMA,
                     WRITTEN_DETAILS_COLUMNS, written_details_schema)


# COPY-like CSV: doubled quotes and line ends inside quoted fields, malformed rows are
# errors. Line ends in fields make a file unsplittable, so large loads want many files.
CSV_OPTIONS = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}


# Files of at most 400,000 rows (some 9 MB): a reader packs no more rows into a task than with larger snappy files.
PARQUET_OPTIONS = {"compression": "zstd", "maxRecordsPerFile": 400_000}
OPEN_MONTHS = 128       # files that a task holds open while rows are dealt by month
MONTH_SCANS = 512       # months gathered by a scan each; more are shuffled by month
# One task a month, or one for each 8 MB of it: what a task sorts fits its memory.
GATHER_SETTINGS = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "64k",
                   "spark.sql.files.minPartitionNum": "1"}


class SchemaError(ValueError):
    pass


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files at a path, folder or pattern; hidden ones are left out. No match is Spark's PATH_NOT_FOUND."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [x for x in fs.globStatus(where) or []]
    if not todo:
        spark.read.text(path)
    while todo:
        x = todo.pop()
        if x.isDirectory():
            todo += [y for y in fs.listStatus(x.getPath()) if y.getPath().getName()[0] not in "_."]
        else:
            out.append(x.getPath().toString())
    return sorted(out)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of one file: its first record."""
    first = spark.read.options(**CSV_OPTIONS | {"header": False, "enforceSchema": True, "multiLine": False}).csv(file).limit(
        1).collect() if file.endswith((".bz2", ".zst", ".deflate", ".lz4", ".snappy")) else None
    if first is not None:
        return tuple(c if c is not None else f"_c{i}" for i, c in enumerate(first[0])) if first else ()
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        if file.endswith(".gz"):        # read here: a job per file would grow with the number of files
            stream = jvm.java.util.zip.GZIPInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.lstrip("\ufeff")]), ())) if line else ()


def _read_named(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns as text, bound by each file's own header: one scan per distinct header."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        header = _header(spark, file)
        missing = sorted(set(wanted) - set(header))
        if missing:
            raise SchemaError(f"Missing columns in {file}: {missing}" if header else f"Empty input: {file}")
        groups.setdefault(header, []).append(file)
    if not groups:
        raise SchemaError(f"Empty input: {path}")
    out = None
    for header, files in groups.items():
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
        rows = spark.read.options(**CSV_OPTIONS).schema(schema).csv(files).select(*[f"`{c}`" for c in wanted])
        out = rows if out is None else out.unionByName(rows)
    return out


def read_written_details_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV load that binds columns by header name, not position.

    Empty unquoted fields load as null. A missing input path raises Spark's
    PATH_NOT_FOUND; a header lacking a known column raises ``SchemaError``.
    Columns are renamed to engine names once, here.
    """
    raw = _read_named(spark, path, [src for src, _, _ in WRITTEN_DETAILS_COLUMNS])
    return raw.select(*[F.col(f"`{src}`").cast(typ).alias(eng) for src, eng, typ in WRITTEN_DETAILS_COLUMNS])


def to_source_names(df: DataFrame) -> DataFrame:
    """Engine names back to source names (for CSV export in the source layout)."""
    names = {eng: src for src, eng, _ in WRITTEN_DETAILS_COLUMNS}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def read_budget_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = {"plan": PLAN_SCHEMA, "forecast": FORECAST_SCHEMA, "calendar": CALENDAR_SCHEMA}[kind]
    raw = _read_named(spark, path, schema.fieldNames())
    # An ANSI cast: text that is not of the column's type is an error.
    typed = [F.expr(f"cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schema.fields]
    return raw.select(*typed)


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows placed and sorted for ``write_fact``.

    ``REBALANCE(report_month)`` lets AQE size the write tasks at run time: a month
    holding a third of all rows is split over several tasks, small months are
    coalesced, so files come out near the advisory size without a sampling pass.
    Sorting by date within each task gives tight min/max statistics per row group
    for day-level filters inside a month.
    """
    return rows.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(PARTITION_COLUMN, "report_date")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the writes inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deal_by_month(rows: DataFrame, path: str) -> None:
    """Write rows into month folders as they come, without a shuffle.

    A task keeps the files of up to ``OPEN_MONTHS`` months open, with small buffers, so its rows
    are not sorted either: a task's rows may be those of one large CSV file, more than its memory
    holds. Rows of further months are sorted and then written.
    """
    with _settings(rows.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS)}):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**PARQUET_OPTIONS)
             .option("parquet.block.size", 8 << 20).option("parquet.dictionary.page.size", 64 << 10)
             .partitionBy(PARTITION_COLUMN).parquet(path))


def _gathered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that ``deal_by_month`` wrote, placed and sorted as by ``laid_out``: each month's files are one scan, so
    no task reads two months and none are shuffled; splits deal a large month over many tasks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    months = sorted(x.getPath().toString() for x in fs.listStatus(where) if x.isDirectory())
    if not 0 < len(months) <= MONTH_SCANS:
        return laid_out(read_fact(spark, path, schema))
    schema = read_fact(spark, path, schema).schema
    scans = [spark.read.schema(schema).option("basePath", path).parquet(m) for m in months]
    return functools.reduce(DataFrame.union, scans).sortWithinPartitions(PARTITION_COLUMN, "report_date")


def write_fact(fact: DataFrame, path: str, placed: bool = False) -> None:
    """Write the fact as Parquet partitioned by report month; ``placed`` rows are ``laid_out`` already.

    Other rows are first dealt into month folders beside the table, then each month is gathered and
    sorted: whole rows as Parquet are a fraction of the same rows in a shuffle.
    """
    if PARTITION_COLUMN not in fact.columns:
        fact = fact.withColumn(PARTITION_COLUMN, F.trunc("report_date", "month"))
    spark = fact.sparkSession
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    if placed or table.getParent() is None:         # nothing lies beside a root folder
        return _write_months(fact if placed else laid_out(fact), path)
    dealt = spark._jvm.org.apache.hadoop.fs.Path(table.getParent(), f"_{table.getName()}-{uuid.uuid4().hex[:12]}")
    try:
        deal_by_month(fact, dealt.toString())
        with _settings(spark, GATHER_SETTINGS):
            _write_months(_gathered(spark, dealt.toString(), fact.schema), path)
    finally:
        dealt.getFileSystem(spark._jsc.hadoopConfiguration()).delete(dealt, True)


def _write_months(rows: DataFrame, path: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**PARQUET_OPTIONS)
         .partitionBy(PARTITION_COLUMN).parquet(path))


def read_fact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read the partitioned fact; with the written schema known, no inference job runs."""
    schema = schema or spark.read.parquet(path).schema
    fields = [f for f in schema.fields if f.name != PARTITION_COLUMN]
    fields.append(T.StructField(PARTITION_COLUMN, T.DateType()))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def footer_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The fact for minimum, maximum and count over all rows, which Parquet footers answer.

    Read through the second version of the file source, which pushes such aggregates into the
    footers; no data page is read. Other queries want ``read_fact``.
    """
    fields = [f for f in schema.fields if f.name != PARTITION_COLUMN] + [T.StructField(PARTITION_COLUMN, T.DateType())]
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")       # concerns this kind of scan alone
    old = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in old.split(",") if x != "parquet"))
    try:
        return spark.read.schema(T.StructType(fields)).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", old)


def resolve_vendor_column(df: DataFrame) -> str:
    """The vendor column to group by: first present of vendor (5), vendor (6), vendor."""
    for c in V.VENDOR_COLUMN_PRIORITY:
        if c in df.columns:
            return c
    raise ValueError("No vendor column found in the fact. Expected one of: "
                     + ", ".join(V.VENDOR_COLUMN_PRIORITY) + ".")


def empty_fact(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], written_details_schema())


def register_views(tables) -> None:
    """Expose the engine tables and the monthly KPI view to ``spark.sql``."""
    from ..operators.rollup import monthly_kpis
    tables.fact.createOrReplaceTempView("fact_written_details")
    tables.plan.createOrReplaceTempView("fact_plan")
    tables.forecast.createOrReplaceTempView("fact_forecast")
    tables.calendar.createOrReplaceTempView("dim_calendar")
    monthly_kpis(tables.fact).createOrReplaceTempView("vw_monthly_premium_kpis")
