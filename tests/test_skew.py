"""Hot keys: one pet and one channel each hold a third of all rows.

Results must equal a brute force over the same rows, and every aggregation must
be partial (map-side) before its shuffle, so a hot key reaches a reducer as one
row per map task rather than as a third of the data.
"""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd

from conftest import FACT_SCHEMA, NEW, REN, CAN
from premia.operators import rollup as R
from premia.plans.period import Period


def _rows(n=6000, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        pet = "HOT" if hot else f"P{rnd.randrange(800)}"
        channel = "DTC" if i % 3 == 1 else rnd.choice(["Vet", "Partner", "Aggregator"])
        code = rnd.choice([NEW, NEW, REN, REN, REN, CAN])
        d = dt.date(2026, 1, 1) + dt.timedelta(days=rnd.randrange(120))
        amt = Decimal(rnd.randrange(-5000, 90000)) / 100
        out.append((d, code, amt, pet, rnd.choice([0, 1, None]), "CA", channel, "AI", "V"))
    return out


def test_hot_pet_and_channel_drilldown_equals_brute_force(spark):
    rows = _rows()
    fact = spark.createDataFrame(rows, FACT_SCHEMA).repartition(6)
    period = Period("2026-01-01", "2026-04-30")
    got = {r["drilldown_group"]: r for r in R.drilldown(fact, period, "Channel").collect()}

    pdf = pd.DataFrame(rows, columns=["d", "code", "amt", "pet", "ret", "state", "ch", "prod", "vend"])
    keep = pdf["ret"].fillna(0) != 1
    for ch, g in pdf.groupby("ch"):
        k = keep[g.index]
        r = got[ch]
        assert r["actual_gwp"] == float(sum(g["amt"]))
        assert r["nbw_unique_pets"] == g[(g["code"] == NEW) & k]["pet"].nunique()
        assert r["renewal_unique_pets"] == g[(g["code"] == REN) & k]["pet"].nunique()
    assert len(got) == pdf["ch"].nunique()

    df = R.drilldown(fact, period, "Channel")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    first_exchange = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    below = "\n".join(lines[first_exchange:])
    assert "partial_" in below  # map-side partial aggregation under the first shuffle
