"""Build the engine's four tables from the driver's TPC-H-ish test tables.

The mapping (which source column plays which business column) is the fixture
specification; the joins and projections below are plain DataFrame operations.

Join order is chosen for scale: ``orders ⋈ customer ⋈ nation`` first (orders is
~4x smaller than lineitem, so the custkey shuffle moves the smaller side); ``lineitem``
joins part, then those orders once on orderkey, then supplier. All shuffles, also the one
that lays the fact out by month, move keys, codes and dates; texts are built after it. With AQE's
skew-join handling on, a key holding a third of the rows is split across tasks. Only the columns
each side needs are read (column pruning reaches the scans), and the as-of cut on
``l_shipdate`` is pushed to the lineitem scan. Spark decides broadcast vs
sort-merge from the sides' measured sizes (``autoBroadcastJoinThreshold`` + AQE); suppliers are
broadcast up to ``BROADCAST_ROWS``, counted first. Nothing is broadcast without such a check.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.classify import classify
from ..session import new_table_path
from .schema import MONEY, PARTITION_COLUMN
from .written_details import footer_scan, laid_out, read_fact, write_fact

# FIXED VALUES — fixture parameters (the standard periods of the test data).
AS_OF_EXCLUSIVE = "2001-05-05"   # optional snapshot cut; registered queries read whole tables
PLAN_YEAR = 2001
BASE_YEAR = 2000
TREND_YEAR = 1999
ACTUALS_CUTOFF_MONTH = 4
FULL_RANGE = ("2001-01-01", "2001-05-04")
PARTIAL_RANGE = ("2001-02-10", "2001-05-04")
SELECTED_MONTH = "2001-04-01"
LEAP_MONTH = "2001-02-01"
EMPTY_RANGE = ("1990-01-01", "1990-12-31")

# FIXED VALUES — fixture mapping of source attributes to business values.
SEGMENT_TO_CHANNEL = [
    ("AUTOMOBILE", "DTC"),
    ("BUILDING", "Aggregator"),
    ("FURNITURE", "Veterinary"),
    ("HOUSEHOLD", "Employee Benefits"),
]
CHANNEL_FALLBACK = "Partner"
PRIORITY_TO_SUB_CHANNEL = [
    ("1-URGENT", "Referral Program"),
    ("2-HIGH", "Paid Search"),
    ("3-MEDIUM", "Comparison Site"),
    ("5-LOW", "Vet Referrals"),
]
NULL_CHANNEL_EVERY = 33     # c_custkey % 33 = 0 -> no channel
NULL_HOSPITAL_EVERY = 7     # l_suppkey % 7 = 0 -> no hospital

BROADCAST_ROWS = 500_000    # suppliers sent to every task, about 50 MB; more are joined by a shuffle of the line items

# FIXED VALUES — the columns read from each test table, with their stored types.
# A declared schema skips per-table schema inference and prunes columns at the source.
TEST_TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_size int",
    "supplier": "s_suppkey bigint, s_name string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TEST_TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Codes of the fixed labels: what the joins shuffle is small numbers, the labels come last.
_TRANS_CODES = [V.NEW_POLICY, V.RENEW_POLICY, V.MID_TERM_ADJUSTMENT, V.REINSTATE_POLICY, V.CANCEL_POLICY]
_CHANNELS = [ch for _, ch in SEGMENT_TO_CHANNEL] + [CHANNEL_FALLBACK]
_SUB_CHANNELS = [sub for _, sub in PRIORITY_TO_SUB_CHANNEL]


def _code(labels: list[str], label: str) -> Column:
    return F.lit(labels.index(label) + 1).cast("tinyint")


def _label(labels: list[str], code: Column) -> Column:
    """The label of a code, null for no code."""
    expr = F.when(code == 1, labels[0])
    for k, label in enumerate(labels[1:], 2):
        expr = expr.when(code == k, label)
    return expr


# The codes of a row lie in the bits of one number, from the lowest on: transaction (3), returned (2: 0 null, 1 no,
# 2 yes), cat (1), channel and sub-channel (3 each: 0 null). A column each would take eight bytes of every shuffled row.
_RETURNED, _CAT, _CHANNEL, _SUB_CHANNEL = 3, 5, 6, 9


def _bits(at: int, n: int) -> Column:
    return F.shiftright("codes", at).bitwiseAND(F.lit((1 << n) - 1))


def _trans_code() -> Column:
    ln, st = F.col("l_linenumber"), F.col("l_linestatus")
    code = lambda label: _code(_TRANS_CODES, label)
    return (F.when(ln <= 2, code(V.NEW_POLICY))
            .when(ln <= 5, code(V.RENEW_POLICY))
            .when((ln == 6) & (st == "O"), code(V.MID_TERM_ADJUSTMENT))
            .when(ln == 6, code(V.REINSTATE_POLICY))
            .otherwise(code(V.CANCEL_POLICY)))


def _channel() -> Column:
    seg = F.col("c_mktsegment")
    expr = F.when(F.col("c_custkey") % NULL_CHANNEL_EVERY == 0, F.lit(None).cast("tinyint"))
    for s, ch in SEGMENT_TO_CHANNEL:
        expr = expr.when(seg == s, _code(_CHANNELS, ch))
    return expr.otherwise(_code(_CHANNELS, CHANNEL_FALLBACK))


def _sub_channel() -> Column:
    pr = F.col("o_orderpriority")
    expr = None
    for p, sub in PRIORITY_TO_SUB_CHANNEL:
        code = _code(_SUB_CHANNELS, sub)
        expr = F.when(pr == p, code) if expr is None else expr.when(pr == p, code)
    return expr


def _bounded(rows: DataFrame) -> DataFrame:
    """Rows to be broadcast if they are few, by count: Spark's own estimates stop at a few megabytes of files."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _joined(spark: SparkSession, sf_dir: str, as_of_exclusive: str | None) -> DataFrame:
    """One narrow row of keys, codes and dates per line item with an order, part and supplier."""
    li = _read(spark, sf_dir, "lineitem")
    if as_of_exclusive:
        li = li.where(F.col("l_shipdate") < F.lit(as_of_exclusive).cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    amount = F.when(F.col("l_linenumber") == 7, -price).otherwise(price)
    returned = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", amount.try_cast(MONEY).alias("price"),
                   F.when(amount.try_cast(MONEY).isNull(), amount).alias("price_unfit"),     # an error if the row is kept
                   F.col("l_shipdate").cast("date").alias("report_date"),
                   (_trans_code() + returned * (1 << _RETURNED)).cast("int").alias("codes"))
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("channel_type"),
        F.col("o_orderdate").cast("date").alias("trans_date"), F.coalesce(_sub_channel(), F.lit(0)).alias("sub"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.coalesce(_channel(), F.lit(0)).alias("chan"))
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = _read(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(F.col("p_size") % 3 == 0, F.lit(False)).alias("cat"))
    supplier = _bounded(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))

    order_attrs = (orders
                   .join(customer, orders.o_custkey == customer.c_custkey)
                   .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                   .select("o_orderkey", "channel_type", "trans_date", "n_name",
                           (F.col("chan") * (1 << _CHANNEL) + F.col("sub") * (1 << _SUB_CHANNEL)).cast("int").alias("order_codes")))

    # No hand-placed repartition: the planner's own join shuffles are the ones AQE
    # may split when one key holds a large share of rows (skew join). Part comes first:
    # where it is too large to broadcast, that shuffle moves no column of the orders.
    return (li
            .join(part, li.l_partkey == part.p_partkey)
            .withColumn("codes", F.col("codes") + F.when(F.col("cat"), 1 << _CAT).otherwise(0))
            .drop("p_partkey", "cat")
            .join(order_attrs, li.l_orderkey == order_attrs.o_orderkey)
            .join(supplier, li.l_suppkey == supplier.s_suppkey)
            .select("l_orderkey", "l_partkey", "trans_date", "report_date", "price", "price_unfit",
                    (F.col("codes") + F.col("order_codes")).alias("codes"), F.col("n_name").alias("state"), "channel_type",
                    F.when(F.col("l_suppkey") % NULL_HOSPITAL_EVERY != 0, F.col("s_name")).alias("hospital"),
                    F.trunc("report_date", "month").alias(PARTITION_COLUMN)))


def fixture_fact(spark: SparkSession, sf_dir: str, as_of_exclusive: str | None = None, by_month: bool = False) -> DataFrame:
    """The written-details fact (engine column names), as a lazy DataFrame.

    Every line item becomes a fact row. ``as_of_exclusive`` optionally takes a
    snapshot of the actuals known before a date (pushed to the lineitem scan).
    ``by_month`` lays the rows out for ``write_fact`` while they are still narrow.
    """
    rows = _joined(spark, sf_dir, as_of_exclusive)
    if by_month:
        rows = laid_out(rows)
    fact = rows.select(
        F.concat(F.lit("POL"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("policy_number"),
        F.concat(F.lit("PET"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("pet_id"),
        "trans_date",
        "report_date",
        _label(_TRANS_CODES, _bits(0, 3)).alias("trans_code"),
        F.coalesce("price", F.col("price_unfit").cast(MONEY)).alias("written_amount"),
        F.when(_bits(_RETURNED, 2) > 0, _bits(_RETURNED, 2) - 1).alias("returned_pet"),
        "state",
        _label(_CHANNELS, _bits(_CHANNEL, 3)).alias("channel"),
        _label(_SUB_CHANNELS, _bits(_SUB_CHANNEL, 3)).alias("sub_channel"),
        "channel_type",
        "hospital",
        F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0).alias("wellness"),
        F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(1).alias("accident"),
        F.when(_bits(_CAT, 1) == 1, "Cat").otherwise("Dog").alias("species"),
        PARTITION_COLUMN,
    )
    fact = classify(fact)
    return fact.select(*[c for c in fact.columns if c != PARTITION_COLUMN], PARTITION_COLUMN)


# ---------------------------------------------------------------------------
# Budget facts (noise-free allocation; see operators/synth.py for the noisy one)
# ---------------------------------------------------------------------------

def plan_fixture(spark: SparkSession, plan_year: int = PLAN_YEAR) -> DataFrame:
    """Noise-free plan allocation: metric base x seasonality x growth x normalised weight.

    Rows come from exploding literal arrays (months x metrics x dimension values);
    there is no join. Weights are normalised within each dimension type.
    """
    metrics = F.array(*[F.struct(F.lit(m).alias("metric_name"), F.lit(float(b)).alias("base"),
                                 F.lit(s).alias("seasonal"))
                        for m, (b, s) in V.PLAN_BASES.items()])
    dims = F.array(*[F.struct(F.lit(t).alias("dimension_type"), F.lit(v).alias("dimension_value"),
                              F.lit(float(w)).alias("w"))
                     for t, v, w in V.PLAN_FIXTURE_WEIGHTS])
    rows = (spark.range(1)
            .select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
            .select("n", F.explode(metrics).alias("m"))
            .select("n", "m", F.explode(dims).alias("d")))
    nw = F.col("d.w") / F.sum("d.w").over(Window.partitionBy("n", "m.metric_name", "d.dimension_type"))
    n = F.col("n").cast("double")
    seasonal_amount = (F.col("m.base")
                       * (F.lit(1.0) + F.lit(V.PLAN_SEASONAL_AMPLITUDE) * F.sin(n / F.lit(12.0) * F.lit(2.0) * F.lit(math.pi)))
                       * (F.lit(1.0) + n * F.lit(V.PLAN_SEASONAL_GROWTH)))
    flat_amount = F.col("m.base") * (F.lit(1.0) + n * F.lit(V.PLAN_AVERAGE_GROWTH))
    amount = F.when(F.col("m.seasonal"), seasonal_amount).otherwise(flat_amount) * nw
    return rows.select(
        F.make_date(F.lit(plan_year), F.col("n"), F.lit(1)).alias("plan_month"),
        F.col("m.metric_name").alias("metric_name"),
        F.col("d.dimension_type").alias("dimension_type"),
        F.col("d.dimension_value").alias("dimension_value"),
        amount.cast("decimal(18,2)").alias("plan_amount"),
    )


def forecast_fixture(plan: DataFrame) -> DataFrame:
    """Forecast = plan x mean bias for the months from the first forecast month on."""
    return (plan.where(F.month("plan_month") >= V.FORECAST_FIRST_MONTH)
            .select(F.col("plan_month").alias("forecast_month"), "metric_name", "dimension_type",
                    "dimension_value",
                    (F.col("plan_amount") * F.lit(V.FORECAST_MEAN_BIAS).cast("decimal(4,3)"))
                    .cast("decimal(18,2)").alias("forecast_amount")))


@dataclass
class Tables:
    fact: DataFrame
    plan: DataFrame
    forecast: DataFrame
    calendar: DataFrame
    fact_path: str | None = None
    monthly: DataFrame | None = None   # materialised monthly KPI view (decimal measures)
    footers: DataFrame | None = None   # the fact for MIN, MAX and COUNT from file footers


_CACHE: dict[tuple[str, str], Tables] = {}


def load_tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Tables:
    """The four engine tables for a test-data folder.

    With ``materialize`` each table is written once per session as Parquet into the
    shared folder (``spark.checkpoint.dir``), the fact partitioned by report month;
    queries then read files with partition pruning and statistics, lineage back to
    the six-way join is cut, and a lost executor only re-reads files.
    """
    from .calendar import calendar_from_fact

    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    fact = fixture_fact(spark, sf_dir, by_month=materialize)
    plan = plan_fixture(spark)
    forecast = forecast_fixture(plan)
    path = footers = None
    if materialize:
        path = new_table_path(spark, "fact_written_details")
        write_fact(fact, path, placed=True)
        fact = read_fact(spark, path, fact.schema)
        footers = footer_scan(spark, path, fact.schema)
        plan = _materialize(plan, new_table_path(spark, "fact_plan"))
        forecast = _materialize(forecast, new_table_path(spark, "fact_forecast"))
    calendar = calendar_from_fact(fact)
    monthly = None
    if materialize:
        from ..operators.views import MonthlyView
        calendar = _materialize(calendar, new_table_path(spark, "dim_calendar"))
        monthly = MonthlyView(new_table_path(spark, "vw_monthly_premium_kpis")).build(fact).read(spark)
    tables = Tables(fact=fact, plan=plan, forecast=forecast, calendar=calendar, fact_path=path, monthly=monthly,
                    footers=footers)
    _CACHE[key] = tables
    return tables


def _materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a small derived table once (one file) and read it back."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_date(s: str | dt.date) -> dt.date:
    return s if isinstance(s, dt.date) else dt.date.fromisoformat(s)
