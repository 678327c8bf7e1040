"""Synthetic data jobs: written-details fact, plan and forecast with noise.

Every random draw is a function of (row id, column name, seed) only —
``xxhash64`` mapped to a uniform in [0, 1), normals by Box–Muller — so the output
does not depend on partitioning, task retries or executor loss, and a billion
rows are generated by ``spark.range`` in parallel with no driver loop and no
chunking. Values differ from a sequential numpy stream; distributions match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.classify import classify, derive_flags, derive_product

TWO53 = float(2 ** 53)

# FIXED VALUES — generator domains (in natural order) and weights.
ALL_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
CHANNELS = ["DTC", "Aggregator", "Veterinary", "Employee Benefits", "Partner", ""]
CHANNEL_WEIGHTS = [0.33, 0.18, 0.22, 0.12, 0.12, 0.03]
SUB_CHANNELS = ["Referral Program", "Paid Search", "Organic Search", "Vet Referrals",
                "Employer Direct", "Affinity Partner", "Comparison Site", "Direct Mail", ""]
CHANNEL_TYPES = ["Digital", "Offline", "Veterinary Providers", "Employee Benefits", "Partner Network", "Referral", ""]
HOSPITAL_AFFILIATES = ["North Star Animal Hospital", "Paw Health Network", "Metro Vet Group",
                       "Healthy Pets Clinic", "Community Animal Care", "Independent Vet Partner", ""]
CAMPAIGN_OWNERS = ["Marketing", "Partnerships", "Veterinary Growth", "Employee Benefits",
                   "Digital Acquisition", "Retention"]
COMPANIES = ["APIC", "IAIC"]
COMPANY_WEIGHTS = [0.42, 0.58]
SPECIES = ["Dog", "Cat"]
SPECIES_WEIGHTS = [0.68, 0.32]
BASE_PLANS = ["Accident Only", "Accident & Illness", "Complete Coverage", "Essential Care"]
POLICY_LIMITS = ["5,000", "10,000", "Unlimited"]
LIMIT_TYPES = ["Annual", "Per Incident"]
TRANS_CODE_WEIGHTS = [0.24, 0.54, 0.11, 0.07, 0.04]
CANCEL_CODES = ["Customer Request", "Non Payment", "Moved Carrier", "Coverage Not Needed", "Underwriting"]
PET_LINES = ["Pet Insurance", "Wellness Add-On", "Accident Coverage"]
RETURNED_PET_RATE = 0.16
COVERAGE_RATES = {  # flag -> probability of 1
    "wellness": 0.28, "accident": 0.82, "cancer": 0.26, "exam_fees": 0.48,
    "prescriptions": 0.42, "pt_rehab": 0.22, "holistic": 0.18, "rac": 0.12,
}
PERIODS = [("2024-01-01", "2024-12-31", 0.38), ("2025-01-01", "2025-12-31", 0.42), ("2026-01-01", "2026-04-30", 0.20)]
EARNED_RATIO = (0.92, 0.05)
AGE_GAMMA = (2.1, 2.0)  # shape, scale
AGE_CLIP = (0.1, 14.0)

DIMENSION_SETS = [
    ("Total", ["All"]),
    ("State", ALL_STATES),
    ("IPH Channel (5)", ["DTC", "Aggregator", "Vet", "Employee Benefits", "Partner", "DTC (non-Aggs)"]),
    ("IPH Channel (6)", ["DTC Direct", "Aggregator", "Vet / All Other Vets", "EB Direct Bill", "Affinity / Partner",
                         "Referred by Friend"]),
    ("Vendor (5)", ["DTC / Other", "Aggregator Marketplace", "All Other Vets", "Employee Benefits", "Partner Network",
                    "Referred by Friend"]),
    ("Vendor (6)", ["DTC", "Aggregator", "Vet / Other", "EB Discount Sites", "Affinity Partner", "Referred by Friend"]),
    ("PRODUCT", ["AI", "AO", "AI-WELL", "AO-WELL"]),
    ("Species", ["Dog", "Cat"]),
]
CONSTANT_WEIGHTS = {
    "IPH Channel (5)": {"DTC": 0.30, "Aggregator": 0.18, "Vet": 0.25, "Employee Benefits": 0.12, "Partner": 0.12,
                        "DTC (non-Aggs)": 0.03},
    "IPH Channel (6)": {"DTC Direct": 0.23, "Aggregator": 0.18, "Vet / All Other Vets": 0.25, "EB Direct Bill": 0.12,
                        "Affinity / Partner": 0.12, "Referred by Friend": 0.10},
    "Vendor (5)": {"DTC / Other": 0.25, "Aggregator Marketplace": 0.18, "All Other Vets": 0.24,
                   "Employee Benefits": 0.12, "Partner Network": 0.13, "Referred by Friend": 0.08},
    "Vendor (6)": {"DTC": 0.24, "Aggregator": 0.18, "Vet / Other": 0.24, "EB Discount Sites": 0.12,
                   "Affinity Partner": 0.13, "Referred by Friend": 0.09},
    "PRODUCT": {"AI": 0.32, "AO": 0.18, "AI-WELL": 0.28, "AO-WELL": 0.22},
    "Species": {"Dog": 0.68, "Cat": 0.32},
}
STATE_WEIGHT_BANDS = [  # (states, low, high); other states use the last band
    (["CA", "TX", "FL", "NY", "PA"], 0.035, 0.065),
    (["IL", "OH", "GA", "NC", "AZ", "WA", "MI", "NJ", "VA", "MA"], 0.018, 0.035),
    ([], 0.006, 0.018),
]
PLAN_NOISE_SD = 0.015
FORECAST_NOISE_SD = 0.02
FORECAST_BIAS_SD = 0.035
PLAN_SEED_OFFSET = 99


# ---------------------------------------------------------------------------
# Hashed randomness
# ---------------------------------------------------------------------------

def uniform(seed: int, name: str, *keys: Column) -> Column:
    """Uniform in [0, 1) from the keys, the column name and the seed."""
    h = F.xxhash64(F.lit(seed), F.lit(name), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(TWO53)  # top 53 bits: exact, < 1


def normal(seed: int, name: str, *keys: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    u1 = F.greatest(uniform(seed, name + "#1", *keys), F.lit(1e-300))
    u2 = uniform(seed, name + "#2", *keys)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return F.lit(mean) + F.lit(sd) * z


def choice(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """Pick from ``values`` by a uniform ``u`` (uniform or cumulative weights)."""
    if weights is None:
        idx = F.least(F.floor(u * len(values)).cast("int"), F.lit(len(values) - 1)) + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), idx)
    total, acc = float(sum(weights)), 0.0
    expr = None
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def gamma_approx(seed: int, name: str, key: Column, shape: float, scale: float) -> Column:
    """Gamma draw by the Wilson–Hilferty cube transform of a normal."""
    z = normal(seed, name, key)
    c = 1.0 / (9.0 * shape)
    return F.lit(shape * scale) * F.pow(F.greatest(F.lit(1.0 - c) + z * F.lit(math.sqrt(c)), F.lit(0.0)), 3)


# ---------------------------------------------------------------------------
# G7 / G8 — written details
# ---------------------------------------------------------------------------

def rating_amount(seed: int, key: Column) -> Column:
    """Written amount: base x species x product x state factors, floored, then the
    transaction-code factor (negative for cancels), rounded to cents."""
    base = normal(seed, "base", key, mean=V.RATING_BASE_MEAN, sd=V.RATING_BASE_SD)
    species = F.when(F.col("species") == "Dog", V.RATING_SPECIES["Dog"]).otherwise(V.RATING_SPECIES["Cat"])
    product = F.lit(1.0)
    for p, f in reversed(list(V.RATING_PRODUCT.items())):
        product = F.when(F.col("product") == p, F.lit(f)).otherwise(product)
    state = F.when(F.col("state").isin(V.RATING_HIGH_COST_STATES), V.RATING_HIGH_COST_FACTOR).otherwise(1.0)
    amount = F.greatest(base * species * product * state, F.lit(V.RATING_FLOOR))
    code = F.col("trans_code")
    out = amount
    for c, (mean, sd, sign) in V.RATING_CODE_FACTORS.items():
        factor = normal(seed, "code_factor", key, mean=mean, sd=sd)
        out = F.when(code == c, amount * factor * F.lit(float(sign))).otherwise(out)
    return F.round(out, 2)


def synth_written_details(spark: SparkSession, total_rows: int, seed: int = 42,
                          num_partitions: int | None = None) -> DataFrame:
    """``total_rows`` policy transactions over three periods (weights .38/.42/.20,
    the last takes the remainder), with derived classification columns."""
    n_parts = num_partitions or max(1, min(10_000, total_rows // 1_000_000 + 1))
    ids = spark.range(0, total_rows, numPartitions=n_parts)
    rid = F.col("id")
    pet_universe = max(total_rows // 3, 1)
    # period boundaries by row id
    bounds, acc = [], 0
    for i, (start, end, w) in enumerate(PERIODS):
        rows = int(total_rows * w) if i < len(PERIODS) - 1 else total_rows - acc
        bounds.append((acc, acc + rows, start, end))
        acc += rows
    start_col, days_col = None, None
    for lo, hi, start, end in bounds:
        cond = (rid >= lo) & (rid < hi)
        s = F.lit(start).cast("date")
        dd = F.datediff(F.lit(end).cast("date"), s)
        start_col = F.when(cond, s) if start_col is None else start_col.when(cond, s)
        days_col = F.when(cond, dd) if days_col is None else days_col.when(cond, dd)

    def u(name):
        return uniform(seed, name, rid)

    trans_date = F.date_add(start_col, F.floor(u("trans_date") * (days_col + 1)).cast("int"))
    df = ids.select(
        rid.alias("id"),
        trans_date.alias("trans_date"),
        choice(u("trans_code"), V.TRANS_CODES, TRANS_CODE_WEIGHTS).alias("trans_code"),
        choice(u("state"), ALL_STATES).alias("state"),
        choice(u("channel"), CHANNELS, CHANNEL_WEIGHTS).alias("channel"),
        choice(u("sub_channel"), SUB_CHANNELS).alias("sub_channel"),
        choice(u("channel_type"), CHANNEL_TYPES).alias("channel_type"),
        choice(u("hospital"), HOSPITAL_AFFILIATES).alias("hospital"),
        choice(u("species"), SPECIES, SPECIES_WEIGHTS).alias("species"),
        choice(u("company"), COMPANIES, COMPANY_WEIGHTS).alias("company"),
        *[F.when(u(flag) < p, 1).otherwise(0).alias(flag) for flag, p in COVERAGE_RATES.items()],
        choice(u("base_plan"), BASE_PLANS).alias("base_plan"),
        choice(u("policy_limit"), POLICY_LIMITS).alias("policy_limit"),
        choice(u("limit_type"), LIMIT_TYPES).alias("limit_type"),
        choice(u("campaign_owner"), CAMPAIGN_OWNERS).alias("campaign_owner"),
        choice(u("pet_line"), PET_LINES).alias("pet_line"),
    )
    is_cancel = F.col("trans_code") == V.CANCEL_POLICY
    df = df.withColumns({
        "report_date": F.date_add("trans_date", F.floor(u("report_lag") * 5).cast("int")),
        "first_start_date": F.date_sub("trans_date", F.floor(u("first_start") * 365).cast("int")),
        "cover_start_date": F.col("trans_date"),
        "cover_end_date": F.date_add("trans_date", (F.lit(250) + F.floor(u("cover_end") * 120)).cast("int")),
        "policy_number": F.concat(F.lit("POL"), F.lpad((rid + 1).cast("string"), 10, "0")),
        "pet_id": F.concat(F.lit("PET"), F.lpad(
            (F.lit(1) + F.floor(u("pet") * max(pet_universe - 1, 1))).cast("bigint").cast("string"), 10, "0")),
        "returned_pet": F.when(is_cancel & (u("returned") < RETURNED_PET_RATE), 1).otherwise(0),
        "cancel_code": F.when(is_cancel, choice(u("cancel_code"), CANCEL_CODES)).otherwise(F.lit("")),
        "product": derive_product(),
        "campaign_code": F.concat(F.lit("CMP-"), (F.lit(1000) + F.floor(u("campaign") * 8999)).cast("int").cast("string")),
        "enrollment_age": F.least(F.greatest(F.round(gamma_approx(seed, "age", rid, *AGE_GAMMA), 1),
                                             F.lit(AGE_CLIP[0])), F.lit(AGE_CLIP[1])).cast("decimal(10,2)"),
    })
    df = df.withColumn("written_amount", rating_amount(seed, rid).cast("decimal(18,2)"))
    df = df.withColumn("earned_premium", F.round(
        F.col("written_amount").cast("double") * normal(seed, "earned", rid, mean=EARNED_RATIO[0], sd=EARNED_RATIO[1]),
        2).cast("decimal(18,2)"))
    df = derive_flags(classify(df))
    from ..sources.schema import written_details_schema
    return df.select(*[F.col(f.name).cast(f.dataType) for f in written_details_schema().fields])


# ---------------------------------------------------------------------------
# G11 / G12 — plan and forecast with noise
# ---------------------------------------------------------------------------

def _dimension_rows() -> Column:
    rows = []
    for t, values in DIMENSION_SETS:
        for v in values:
            rows.append(F.struct(F.lit(t).alias("dimension_type"), F.lit(v).alias("dimension_value")))
    return F.array(*rows)


def _raw_weight(seed: int, month: Column, metric: Column, kind: str) -> Column:
    t, v = F.col("d.dimension_type"), F.col("d.dimension_value")
    u = uniform(seed, f"state_weight_{kind}", month, metric, v)
    state_w = None
    for states, lo, hi in STATE_WEIGHT_BANDS:
        draw = F.lit(lo) + u * F.lit(hi - lo)
        if states:
            cond = v.isin(states)
            state_w = F.when(cond, draw) if state_w is None else state_w.when(cond, draw)
        else:
            state_w = state_w.otherwise(draw)
    w = F.when(t == "Total", F.lit(1.0)).when(t == "State", state_w)
    for typ, table in CONSTANT_WEIGHTS.items():
        inner = F.lit(0.01)
        for val, wt in table.items():
            inner = F.when(v == val, F.lit(wt)).otherwise(inner)
        w = w.when(t == typ, inner)
    return w.otherwise(F.lit(1.0))


def _base_amount(n: Column) -> Column:
    nd = n.cast("double")
    seasonal = (F.lit(1.0) + F.lit(V.PLAN_SEASONAL_AMPLITUDE) * F.sin(nd / F.lit(12.0) * F.lit(2.0) * F.lit(math.pi)))
    growth = F.lit(1.0) + nd * F.lit(V.PLAN_SEASONAL_GROWTH)
    flat = F.lit(1.0) + nd * F.lit(V.PLAN_AVERAGE_GROWTH)
    out = F.lit(0.0)
    for m, (b, s) in V.PLAN_BASES.items():
        val = F.lit(float(b)) * seasonal * growth if s else F.lit(float(b)) * flat
        out = F.when(F.col("metric_name") == m, val).otherwise(out)
    return out


def _allocation(spark: SparkSession, year: int, first_month: int, seed: int, kind: str,
                bias_sd: float | None, noise_sd: float) -> DataFrame:
    seed = seed + PLAN_SEED_OFFSET
    metrics = F.array(*[F.lit(m) for m in V.BUDGET_METRICS])
    rows = (spark.range(1)
            .select(F.explode(F.sequence(F.lit(first_month), F.lit(12))).alias("n"))
            .select("n", F.explode(metrics).alias("metric_name"))
            .select("n", "metric_name", F.explode(_dimension_rows()).alias("d")))
    month, metric = F.col("n"), F.col("metric_name")
    rows = rows.withColumn("w", _raw_weight(seed, month, metric, kind))
    norm = F.col("w") / F.sum("w").over(Window.partitionBy("n", "metric_name", "d.dimension_type"))
    total = _base_amount(month)
    if bias_sd is not None:
        total = total * normal(seed, f"{kind}_bias", month, metric, mean=V.FORECAST_MEAN_BIAS, sd=bias_sd)
    noise = normal(seed, f"{kind}_noise", month, metric, F.col("d.dimension_type"), F.col("d.dimension_value"),
                   mean=1.0, sd=noise_sd)
    amount = F.round(total * norm * noise, 2).cast("decimal(18,2)")
    return rows.select(F.make_date(F.lit(year), month, F.lit(1)).alias("month"), "metric_name",
                       F.col("d.dimension_type").alias("dimension_type"),
                       F.col("d.dimension_value").alias("dimension_value"), amount.alias("amount"))


def plan_allocation(spark: SparkSession, plan_year: int = 2026, seed: int = 42) -> DataFrame:
    """Plan for 12 months x 7 metrics x 81 dimension values (6,804 rows)."""
    return (_allocation(spark, plan_year, 1, seed, "plan", None, PLAN_NOISE_SD)
            .withColumnRenamed("month", "plan_month").withColumnRenamed("amount", "plan_amount"))


def forecast_allocation(spark: SparkSession, plan_year: int = 2026, seed: int = 42) -> DataFrame:
    """Forecast for months 5-12 (4,536 rows): plan total x per (month, metric) bias."""
    return (_allocation(spark, plan_year, V.FORECAST_FIRST_MONTH, seed, "forecast", FORECAST_BIAS_SD,
                        FORECAST_NOISE_SD)
            .withColumnRenamed("month", "forecast_month").withColumnRenamed("amount", "forecast_amount"))
