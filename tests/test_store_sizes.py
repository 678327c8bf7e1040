"""What stores and CSV trips write."""

import glob
import os

from conftest import FACT_SCHEMA
from premia.operators.pet_buckets import PetBuckets
from premia.sources.sinks import write_csv
from premia.sources.written_details import read_budget_csv
from premia.sources.schema import PLAN_SCHEMA
from test_skew import _rows


def test_buckets_hold_the_columns_that_results_read(spark):
    fact = spark.createDataFrame(_rows(), FACT_SCHEMA).selectExpr("*", "'X' as policy_number", "vendor_5 as vendor_6")
    store = PetBuckets.build(fact, buckets=4)
    for part in (store.even, store.hot):
        assert sorted(part.columns) == sorted([f.split()[0] for f in FACT_SCHEMA.split(", ")] + ["report_month"])


def test_compressed_csv_is_read_back_by_name_without_a_job_per_header(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal
    rows = [(dt.date(2001, 1 + k % 12, 1), "GWP", "Total", f"a,\"{k}", Decimal(k)) for k in range(2000)]
    plan = spark.createDataFrame(rows, PLAN_SCHEMA).repartition(3)
    write_csv(plan.select(*plan.columns[::-1]), str(tmp_path / "packed"), compression="gzip")
    write_csv(plan, str(tmp_path / "plain"))
    size = lambda d: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{d}/part-*"))
    assert size("packed") * 2 < size("plain")
    spark.sparkContext.setJobGroup("headers", "")
    back = read_budget_csv(spark, str(tmp_path / "packed"), "plan")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(back.collect()) == sorted(plan.collect())
