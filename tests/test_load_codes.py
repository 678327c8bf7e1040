"""The codes that the load's shuffles carry in one number come back as the labels they stand for."""

import datetime as dt
import itertools
from decimal import Decimal

import pytest

from premia.sources.fixture import _joined, fixture_fact

SEGMENTS = {"AUTOMOBILE": "DTC", "BUILDING": "Aggregator", "FURNITURE": "Veterinary", "HOUSEHOLD": "Employee Benefits",
            "MACHINERY": "Partner", None: "Partner"}
PRIORITIES = {"1-URGENT": "Referral Program", "2-HIGH": "Paid Search", "3-MEDIUM": "Comparison Site", "5-LOW": "Vet Referrals",
              "4-NOT SPECIFIED": None, None: None}
LINES = {(1, "O"): "New Policy Line", (4, None): "Renew Policy", (6, "O"): "Mid Term Adjustment", (6, "F"): "Reinstate Policy Line",
         (7, "F"): "Cancel Policy Line", (None, None): "Cancel Policy Line"}
RETURNED = {"R": 1, "N": 0, "A": None, None: None}
SIZES = {3: "Cat", 4: "Dog", None: "Dog"}
DAY = dt.datetime(2001, 1, 31)


def _write(spark, at, lines, orders, customers):
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(1, "CANADA")], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame(list(enumerate(SIZES)), "p_partkey bigint, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(1, "S1")], "s_suppkey bigint, s_name string").write.parquet(f"{at}/supplier.parquet")


def test_every_mix_of_codes(spark, tmp_path):
    customers = [(33 if k == 0 else k, 1, seg) for k, seg in enumerate([None, *SEGMENTS])]       # 33: no channel
    channels = {c: None if c == 33 else SEGMENTS[seg] for c, _, seg in customers}
    orders = {n: x for n, x in enumerate(itertools.product(channels, PRIORITIES))}
    lines, want = [], {}
    for (o, (c, pr)), (n, st), flag, (p, size) in itertools.product(orders.items(), LINES, RETURNED, enumerate(SIZES)):
        price = 0.005 + len(lines)
        lines.append((o, p, 1, n, price, flag, st, DAY))
        amount = Decimal(str(price)).quantize(Decimal("0.01"), "ROUND_HALF_UP") * (-1 if n == 7 else 1)
        want[abs(amount)] = (amount, channels[c], PRIORITIES[pr], LINES[n, st], RETURNED[flag], SIZES[size])
    _write(spark, tmp_path, lines, [(o, c, "F", DAY, pr) for o, (c, pr) in orders.items()], customers)
    rows = fixture_fact(spark, str(tmp_path), by_month=True).collect()
    assert len(rows) == len(lines) == len(want)
    assert all(want[abs(r.written_amount)] == (r.written_amount, r.channel, r.sub_channel, r.trans_code, r.returned_pet, r.species)
               for r in rows)
    held = _joined(spark, str(tmp_path), None)
    assert dict(held.dtypes)["price"] == "decimal(18,2)" and dict(held.dtypes)["codes"] == "int"
    assert not {"trans", "returned", "chan", "sub", "cat"} & set(held.columns)


def test_a_price_without_an_amount_fails_only_where_its_row_is_kept(spark, tmp_path):
    _write(spark, tmp_path / "a", [(0, 0, 1, 1, 1.5, None, None, DAY), (9, 0, 1, 1, float("nan"), None, None, DAY),
                                   (0, 0, 1, 1, None, None, None, DAY)], [(0, 1, "P", DAY, None)], [(1, 1, None)])
    assert sorted((r.written_amount for r in fixture_fact(spark, str(tmp_path / "a")).collect()), key=str) == [Decimal("1.50"), None]
    _write(spark, tmp_path / "b", [(0, 0, 1, 7, 1e300, None, None, DAY)], [(0, 1, "P", DAY, None)], [(1, 1, None)])
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        fixture_fact(spark, str(tmp_path / "b")).collect()


def test_suppliers_are_broadcast_by_their_count(spark, tmp_path, monkeypatch):
    from premia.sources import fixture
    _write(spark, tmp_path, [(0, 0, s, 1, 1.5, None, None, DAY) for s in (1, 2, None)], [(0, 1, "P", DAY, None)], [(1, 1, None)])
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fixture_fact(spark, str(tmp_path))
        monkeypatch.setattr(fixture, "BROADCAST_ROWS", 0)
        many = fixture_fact(spark, str(tmp_path))
        assert "strategy=broadcast" in plan(few) and "strategy=broadcast" not in plan(many)
        assert few.collect() == many.collect() and few.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
