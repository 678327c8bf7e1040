"""Tables of periods: what is shuffled, and equal results over many tasks."""

from pyspark.sql import functions as F

from premia.operators import periods as PD
from test_periods import PERIOD, brute, some_periods, some_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_pets_of_all_sets_are_shuffled_once_before_the_sets(spark, make_fact):
    rows = some_rows()
    fact = make_fact(rows)
    periods = spark.createDataFrame(some_periods(), PERIOD)
    first, last = min(p[1] for p in some_periods()), max(p[2] for p in some_periods())
    cells = PD.period_cells(fact, PD._numbered_days(periods, first, last), PD.SETS, rows_per_task=50)
    moved = [x for x in _plan(cells).splitlines() if "Exchange hashpartitioning" in x and "pet_id" in x]
    assert len(moved) == 1 and "hashpartitioning(pet_id" in moved[0], moved
    whole = cells.where("`set` = 'total' and prev < 1").agg(*[F.sum(c) for c in PD._SUMS + PD._PETS]).first()
    assert tuple(whole) == brute(rows, first, last)[None]
