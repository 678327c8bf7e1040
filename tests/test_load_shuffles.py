"""What the load of the fact shuffles: keys, codes and dates, no built texts."""

import datetime as dt

from premia.sources.fixture import fixture_fact


def _tables(spark, at):
    day = dt.datetime(2001, 1, 31)
    spark.createDataFrame([(k, k, k, 1 + k % 7, 10.25 + k, "R" if k % 3 else None, "O" if k % 2 else None, day) for k in range(1, 40)],
                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, k, None if k % 5 == 0 else "P", day, ["1-URGENT", "4-NOT SPECIFIED", None, "5-LOW"][k % 4])
                           for k in range(1, 40)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(k, 1, ["AUTOMOBILE", "BUILDING", "MACHINERY", None][k % 4]) for k in range(1, 40)],
                          "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(1, "CANADA")], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(k, None if k == 6 else k) for k in range(1, 40)], "p_partkey bigint, p_size int").write.parquet(
        f"{at}/part.parquet")
    spark.createDataFrame([(k, f"S{k}") for k in range(1, 40)], "s_suppkey bigint, s_name string").write.parquet(f"{at}/supplier.parquet")


def test_texts_are_built_after_the_last_shuffle_and_keep_their_values(spark, tmp_path):
    _tables(spark, tmp_path)
    fact = fixture_fact(spark, str(tmp_path), by_month=True)
    rows = {r.policy_number: r for r in fact.collect()}
    assert len(rows) == 39
    assert rows["POL0000000033"].channel is None and rows["POL0000000033"].iph_channel_5 == "DTC (non-Aggs)"
    assert [rows[f"POL{k:010}"].channel for k in (4, 5, 6, 7)] == ["DTC", "Aggregator", "Partner", "Partner"]
    assert [rows[f"POL{k:010}"].sub_channel for k in (4, 5, 6, 7)] == ["Referral Program", None, None, "Vet Referrals"]
    assert [rows[f"POL{k:010}"].species for k in (3, 4, 6)] == ["Cat", "Dog", "Dog"]
    assert [rows[f"POL{k:010}"].trans_code for k in (1, 5, 12, 13)] == [
        "New Policy Line", "Mid Term Adjustment", "Reinstate Policy Line", "Cancel Policy Line"]
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RebalancePartitions"):]
    assert "POL" not in below and "PET" not in below and "channel_key" not in below and "Veterinary" not in below
