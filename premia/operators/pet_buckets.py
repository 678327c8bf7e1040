"""The fact bucketed by pet: exact distinct counts without a shuffle of (group, pet) rows.

Rows, with the columns that measures and dimensions read, are written by report month and, inside a month, by a hash of the pet into a fixed
number of buckets. A task of a range query reads one bucket of the period's months, so
all rows of its pets are there: rows are reduced to one per (group, pet) and then to one
per group before anything moves, and the only shuffle carries one row per group and task.

A pet with more than a bucket's even share of all rows would make its task long. Such
pets, fewer than there are buckets, and rows without a pet stay apart in a table laid
out like the fact, whose rows are summed per (group, pet) in two stages. No pet is in both
tables, so their sums and counts add up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import vocab as V
from ..functions.dims import dimension
from ..plans.period import Period
from ..session import new_table_path
from ..sources.schema import PARTITION_COLUMN
from ..sources.written_details import read_fact, write_fact
from . import kpi as K
from . import rollup as R


class PetBuckets:
    """``even``: the bucketed rows; ``hot``: those of pets with many rows and of no pet, or None if there are none."""

    def __init__(self, even: DataFrame, hot: DataFrame | None):
        self.even, self.hot = even, hot

    @classmethod
    def build(cls, fact: DataFrame, buckets: int | None = None) -> "PetBuckets":
        """Write ``fact`` into ``buckets`` buckets (default: the number of shuffle partitions).

        At scale choose as many that a bucket's part of a usual period fits a task.
        """
        spark = fact.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if PARTITION_COLUMN not in fact.columns:
            fact = fact.withColumn(PARTITION_COLUMN, F.trunc("report_date", "month"))
        fact = fact.select(*_columns(fact))
        total = fact.count()
        path = new_table_path(spark, "hot_pets")
        (fact.groupBy(F.col(M.PET).alias("_pet")).agg(F.count(F.lit(1)).alias("_n"))
         .where(F.col("_pet").isNull() | (F.col("_n") * buckets > total)).select("_pet").coalesce(1).write.parquet(path))
        pets = spark.read.schema(f"_pet {fact.schema[M.PET].dataType.simpleString()}").parquet(path)
        if not pets.take(1):
            return cls(_bucketed(spark, fact, buckets), None)
        # fewer pets than buckets have more than their share, so the list is small at any size of the fact
        at = fact[M.PET].eqNullSafe(F.col("_pet"))
        path = new_table_path(spark, "fact_hot_pets")
        write_fact(fact.join(F.broadcast(pets), at, "left_semi"), path)
        return cls(_bucketed(spark, fact.join(F.broadcast(pets), at, "left_anti"), buckets),
                   read_fact(spark, path, fact.schema))

    def measures(self, period: Period, dims: list[str], measures: list) -> DataFrame:
        """``measures`` per group of the named dimensions (none: one row) over the period's rows."""
        parts = [M.aggregate(period.filter(t), {d: dimension(d, t) for d in dims}, measures)
                 for t in (self.even, self.hot) if t is not None]
        if len(parts) == 1:
            return parts[0]
        return parts[0].unionByName(parts[1]).groupBy(*dims).agg(*[F.sum(m.name).alias(m.name) for m in measures])

    def kpi_snapshot_range(self, plan: DataFrame, forecast: DataFrame, period: Period) -> DataFrame:
        return K.range_snapshot_finish(self.measures(period, [], M.core_measures()), plan, forecast, period)

    def drilldown(self, period: Period, group_by: str) -> DataFrame:
        rows = self.measures(period, [group_by], M.core_measures())
        return R.drilldown_finish(rows.withColumnRenamed(group_by, "drilldown_group"))

    def metric_drilldown(self, period: Period, metric: str, group_by: str) -> DataFrame:
        rows = self.measures(period, [group_by], M.metric_measures(metric))
        return R.metric_finish(rows.withColumnRenamed(group_by, "drilldown_group"))


def _columns(fact: DataFrame) -> list[str]:
    """The columns that measures, dimensions and periods read; the others stay in the fact."""
    vendor = [c for c in V.VENDOR_COLUMN_PRIORITY if c in fact.columns][:1]
    read = ["report_date", "trans_code", M.AMOUNT, "returned_pet", M.PET, "state", "iph_channel_5", "product", *vendor,
            PARTITION_COLUMN]
    return [c for c in fact.columns if c in read]


def _bucketed(spark: SparkSession, rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` as a table by month and bucket of the pet; one task writes all files of a bucket."""
    path, name = new_table_path(spark, "fact_by_pet"), f"fact_by_pet_{uuid.uuid4().hex[:12]}"
    (rows.repartition(buckets, M.PET).sortWithinPartitions(PARTITION_COLUMN, M.PET)
     .write.format("parquet").option("path", path).partitionBy(PARTITION_COLUMN)
     .bucketBy(buckets, M.PET).sortBy(M.PET).saveAsTable(name))
    return spark.table(name)
