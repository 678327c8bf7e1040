"""Gapless ids: the numbered rows are shuffled by their order alone."""

from pyspark.sql import functions as F

from premia.functions.ids import with_gapless_ids


def test_rows_are_not_shuffled_by_partition_number(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as where the rows are many
    try:
        got = with_gapless_ids(spark.range(500).repartition(7), [F.desc("id")], "n")
        assert sorted(map(tuple, got.collect())) == [(k, 500 - k) for k in range(1, 501)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
