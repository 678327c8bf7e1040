"""The monthly KPI view, materialised.

Trend, snapshot, plan-comparison and commentary results all read one row per report
month. Computing that from the fact once and keeping it as a small table in the
shared folder replaces a full fact scan per result with a read of one row per
month. The table has one row per month whatever the data volume, so it is kept as
a single file and versioned copy-on-write: after new fact rows land, ``refresh``
recomputes only the touched months (partition-pruned scan of the fact), keeps the
other months' rows, and writes the next version. That is exact, because a month's
distinct pet counts depend only on that month's rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.dims import dimension
from ..sources.schema import PARTITION_COLUMN


def monthly_rollup(fact: DataFrame) -> DataFrame:
    """Decimal-exact monthly measures: month_start, core measures, row_count."""
    return M.aggregate(fact, {"month_start": dimension("Month", fact)}, M.core_measures(row_count=True))


class MonthlyView:
    def __init__(self, base_path: str):
        self.base_path = base_path.rstrip("/")
        self.version = -1
        self.schema = None

    @property
    def path(self) -> str:
        return f"{self.base_path}/v{self.version}"

    def build(self, fact: DataFrame) -> "MonthlyView":
        return self._write(monthly_rollup(fact))

    def refresh(self, fact: DataFrame, months: list[dt.date]) -> "MonthlyView":
        """Recompute the given months only and write the next version of the view."""
        keys = [F.lit(m) for m in months]
        fresh = monthly_rollup(fact.where(dimension("Month", fact).isin(keys)))
        kept = self.read(fact.sparkSession).where(~F.col("month_start").isin(keys))
        return self._write(kept.unionByName(fresh))

    def _write(self, rows: DataFrame) -> "MonthlyView":
        self.version += 1
        self.schema = rows.schema
        # one row per month: a single small file
        rows.coalesce(1).write.mode("overwrite").parquet(self.path)
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _among(months: list) -> Column:
    """The month is one of ``months``, null included."""
    known = F.coalesce(F.col("month_start").isin([m for m in months if m is not None]), F.lit(False))
    return known | F.col("month_start").isNull() if None in months else known


class FreshMonthlyView:
    """The monthly KPI view of a fact folder, brought up to date by itself on every read.

    The folder's data files are compared with those already taken in. New files are one
    append: their rows alone are read, their monthly sums are added as one more set of
    partial sums, and their (month, pet) flags are added to the state that distinct counts
    come from, sorted by month. Only the months the append touches are counted again,
    from the state and not from the fact. A file that is gone (the table was rewritten)
    rebuilds the view. Each step writes its own folder and the list of files last, so a
    broken update is done again from the start and counts nothing twice.
    """

    def __init__(self, spark: SparkSession, fact_path: str, base_path: str):
        self.spark, self.fact_path, self.base = spark, fact_path.rstrip("/"), base_path.rstrip("/")
        self.step, self.known, self.schema = 0, set(), None

    def _at(self, kind: str, step: int) -> str:
        return f"{self.base}/{kind}/{step}"

    def _files(self) -> set[str]:
        """Data files of the fact folder; none before the first load."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.fact_path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.fact_path}/{PARTITION_COLUMN}=*/part-*")) or []
        return {x.getPath().toString() for x in found}

    def refresh(self) -> bool:
        """Takes in what was appended since the last call; True if anything changed."""
        now = self._files()
        if now == self.known and self.schema is not None:
            return False
        if not self.known <= now:
            self.base, self.step, self.known = f"{self.base}-r{self.step}", 0, set()
        new = sorted(now - self.known)
        if not new:
            return False
        rows = self.spark.read.option("basePath", self.fact_path).parquet(*new)
        rows = rows.withColumn(PARTITION_COLUMN, F.col(PARTITION_COLUMN).cast("date"))
        flags = [m for m in M.core_measures() if isinstance(m, M.DistinctPets)]
        sums = [m for m in M.core_measures(row_count=True) if not isinstance(m, M.DistinctPets)]
        key = F.coalesce(F.col(PARTITION_COLUMN), F.trunc("report_date", "month")).alias("month_start")
        rows.groupBy(key).agg(*M._per_pet(sums)).write.mode("overwrite").parquet(self._at("sums", self.step))
        pets = rows.groupBy(key, M.PET).agg(*M._per_pet(flags)).where(" or ".join(f"{m.name} = 1" for m in flags))
        pets.hint("rebalance", "month_start").sortWithinPartitions("month_start").write.mode("overwrite").parquet(
            self._at("pets", self.step))
        sums_now = self._all("sums")
        touched = [r[0] for r in self.spark.read.schema(sums_now.schema).parquet(self._at("sums", self.step)).select(
            "month_start").distinct().collect()]
        view = self._view(sums_now, touched, flags)
        if self.step:
            old = self.spark.read.schema(self.schema).parquet(self._at("view", self.step - 1))
            view = old.where(~_among(touched)).unionByName(view)
        self.schema = view.schema
        view.coalesce(1).write.mode("overwrite").parquet(self._at("view", self.step))      # one row per month
        self.known, self.step = now, self.step + 1
        return True

    def _all(self, kind: str) -> DataFrame:
        steps = [self._at(kind, k) for k in range(self.step + 1)]
        if kind == "sums":
            return self.spark.read.schema(self.spark.read.parquet(steps[-1]).schema).parquet(*steps)
        schema = "month_start date, pet_id string, nbw_unique_pets int, renewal_unique_pets int"
        out = None
        for at in steps:
            rows = self.spark.read.schema(schema).parquet(at)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _view(self, sums: DataFrame, months: list, flags: list) -> DataFrame:
        """The rows of the given months, from all partial sums and the state of those months."""
        core = M.core_measures(row_count=True)
        total = sums.where(_among(months)).groupBy("month_start").agg(
            *[F.sum(m.name).alias(m.name) for m in core if not isinstance(m, M.DistinctPets)])
        pets = self._all("pets").where(_among(months)).groupBy("month_start", M.PET).agg(
            *[F.max(m.name).alias(m.name) for m in flags])
        counts = pets.groupBy("month_start").agg(*[F.sum(m.name).cast("long").alias(m.name) for m in flags])
        zero = F.lit(0).cast("long")
        counts = counts.withColumnRenamed("month_start", "_m")
        return total.join(counts, F.col("month_start").eqNullSafe(F.col("_m")), "left").select(
            "month_start", *[F.coalesce(m.name, zero).alias(m.name) if isinstance(m, M.DistinctPets)
                             else F.col(m.name) for m in core])

    def read(self) -> DataFrame:
        """The view, up to date."""
        self.refresh()
        if self.schema is None:
            raise ValueError(f"No data files in {self.fact_path}")
        return self.spark.read.schema(self.schema).parquet(self._at("view", self.step - 1))
