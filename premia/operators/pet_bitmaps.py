"""Distinct pets as stored bitmaps: range results without a scan of the fact.

Pets get dense numbers (``functions.ids``). For each dimension, group and day the store
keeps the exact money sums, and for each bucket of 32,768 pet numbers the bitmaps of the
new-business and the renewal pets, built by Spark's ``bitmap_construct_agg``. A day's
bitmaps of a group are merged by ``bitmap_or_agg`` over any range of days and counted, so
counts stay exact for every range and nothing is counted twice. The store is partitioned
by month; a range reads its months only. It suits dimensions of few groups: a row of 4 KB
a bitmap is kept for each group, day and bucket with a pet in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.dims import dimension
from ..functions.ids import with_gapless_ids
from ..plans.period import Period
from ..session import new_table_path
from ..sources.schema import PARTITION_COLUMN
from . import kpi as K
from . import rollup as R

SETS = {"total": None, "Week": "Week", "State": "State", "Channel": "Channel", "Product": "Product"}
_SUMS = ["gwp", "nbw_gwp", "renewal_gwp"]
_PETS = ["nbw_unique_pets", "renewal_unique_pets"]
_GROUP = [PARTITION_COLUMN, "set", "grp", "report_date"]
_TYPES = {"Week": "date"}


class PetBitmaps:
    """The store of one fact: ``sums`` and ``pets``, both by month, set, group and day."""

    def __init__(self, sums: DataFrame, pets: DataFrame):
        self.sums, self.pets = sums, pets

    @classmethod
    def build(cls, fact: DataFrame, sets: dict[str, str | None] = SETS) -> "PetBitmaps":
        spark = fact.sparkSession
        keys = cls._keys(fact, sets)
        amounts = [m for m in M.core_measures() if isinstance(m, M.SumOf)]
        sums = (fact.select(dimension("Month", fact).alias(PARTITION_COLUMN), "report_date", M.AMOUNT, "trans_code", F.inline(keys))
                .groupBy(*_GROUP).agg(*M._per_pet(amounts)))
        sums = sums.hint("rebalance", PARTITION_COLUMN).sortWithinPartitions(*_GROUP)
        return cls(_store(spark, sums, "pet_sums"), _store(spark, cls.bitmaps(fact, sets), "pet_bitmaps"))

    @staticmethod
    def _keys(fact: DataFrame, sets: dict[str, str | None]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("set"), (dimension(d, fact) if d else F.lit(None)).cast("string").alias("grp"))
                         for k, d in sets.items()])

    @classmethod
    def bitmaps(cls, fact: DataFrame, sets: dict[str, str | None]) -> DataFrame:
        """The bitmaps by month, set, group, day and bucket of pet numbers, in this order.

        Pets are numbered before the sets are made. What is shuffled and sorted are single
        pet numbers; a bitmap is built where all its rows are, one at a time, and stays there.
        """
        numbers = with_gapless_ids(fact.select(M.PET).where(F.col(M.PET).isNotNull()).distinct(), [F.col(M.PET)], "number")
        flags = [m for m in M.core_measures() if isinstance(m, M.DistinctPets)]
        month = dimension("Month", fact).alias(PARTITION_COLUMN)
        rows = fact.select(month, "report_date", M.PET, cls._keys(fact, sets).alias("_keys"),
                           *[F.coalesce(m.condition, F.lit(False)).alias(m.name) for m in flags]).where(" or ".join(_PETS))
        rows = rows.join(numbers, M.PET).select(
            PARTITION_COLUMN, "report_date", F.bitmap_bucket_number("number").alias("bucket"),
            F.bitmap_bit_position("number").alias("at"), *_PETS, F.inline("_keys"))
        return rows.repartitionByRange(*_GROUP, "bucket").groupBy(*_GROUP, "bucket").agg(*[
            F.bitmap_construct_agg(F.when(F.col(c), F.col("at"))).alias(c) for c in _PETS])

    def measures(self, period: Period, kind: str) -> DataFrame:
        """``(grp, core measures)`` of the period's groups of one dimension."""
        at = period.predicate(self.sums) & (F.col("set") == kind)
        sums = self.sums.where(at).groupBy("grp").agg(*[F.sum(c).alias(c) for c in _SUMS])
        merged = self.pets.where(at).groupBy("grp", "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in _PETS])
        pets = merged.groupBy(F.col("grp").alias("_g")).agg(*[F.sum(F.bitmap_count(c)).alias(c) for c in _PETS])
        zero = F.lit(0).cast("long")
        joined = sums.join(pets, F.col("grp").eqNullSafe(F.col("_g")), "left")
        return joined.select(F.col("grp").cast(_TYPES.get(kind, "string")).alias("grp"), *_SUMS,
                             *[F.coalesce(c, zero).alias(c) for c in _PETS])

    def kpi_snapshot_range(self, plan: DataFrame, forecast: DataFrame, period: Period) -> DataFrame:
        total = self.measures(period, "total").drop("grp")
        return K.range_snapshot_finish(total.agg(*[F.max(c).alias(c) for c in total.columns]), plan, forecast, period)

    def drilldown(self, period: Period, group_by: str) -> DataFrame:
        if group_by not in SETS:
            raise ValueError(f"Invalid drilldown group: {group_by}")
        return R.drilldown_finish(self.measures(period, group_by).withColumnRenamed("grp", "drilldown_group"))


def _store(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = new_table_path(spark, name)
    (rows.write.option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(PARTITION_COLUMN).parquet(path))
    fields = [f for f in rows.schema.fields if f.name != PARTITION_COLUMN] + [rows.schema[PARTITION_COLUMN]]
    return spark.read.schema(type(rows.schema)(fields)).parquet(path)
