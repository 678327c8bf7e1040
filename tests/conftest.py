import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("premia-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="premia-test-ckpt-"))
    yield s


FACT_SCHEMA = ("report_date date, trans_code string, written_amount decimal(18,2), pet_id string, "
               "returned_pet int, state string, iph_channel_5 string, product string, vendor_5 string")

NEW, REN, MTA, CAN, REI = ("New Policy Line", "Renew Policy", "Mid Term Adjustment", "Cancel Policy Line",
                           "Reinstate Policy Line")


def D(s):
    return dt.date.fromisoformat(s)


def M(x):
    return Decimal(str(x))


def row(date, code, amount, pet="P1", returned=0, state="CA", channel="DTC", product="AI", vendor="V1"):
    return (D(date), code, M(amount), pet, returned, state, channel, product, vendor)


@pytest.fixture
def make_fact(spark):
    def _make(rows):
        return spark.createDataFrame(rows, FACT_SCHEMA)
    return _make
