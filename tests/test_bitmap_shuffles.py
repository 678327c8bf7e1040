"""Stored bitmaps are built after the shuffle."""

from premia.operators.pet_bitmaps import PetBitmaps
from premia.plans.period import Period
from test_period_shuffles import _plan
from test_periods import brute, some_periods, some_rows


def test_bitmaps_are_built_after_the_shuffle(spark, make_fact):
    rows = some_rows()
    maps = PetBitmaps.bitmaps(make_fact(rows), {"total": None, "State": "State"})
    plan = _plan(maps)
    above = plan[:plan.rindex("bitmap_construct_agg")]
    assert "Exchange" not in above, plan
    store = PetBitmaps.build(make_fact(rows))
    for _, a, b in some_periods()[:4]:
        got = {r.grp: tuple(r)[1:] for r in store.measures(Period(a, b), "State").collect()}
        assert got == brute(rows, a, b, 5)
