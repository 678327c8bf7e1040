"""Measures over the written-details fact, and exact ratio helpers.

A measure is either a sum of a (conditional) amount or a distinct count of pets
under a condition. ``aggregate`` evaluates any set of them for any grouping in
two hash-aggregate stages:

1. group by (dimensions, pet_id): partial sums and a 0/1 flag per distinct measure;
2. group by dimensions: sum the partial sums, and sum the flags = distinct pets.

Both stages use map-side partial aggregation, so a hot pet, month or channel
collapses to one row per map task before any shuffle, and no ``Expand`` copies
the rows of the fact once per distinct count. Distinct counts are never added across groups:
every grouping is re-aggregated from the fact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V

AMOUNT = "written_amount"
PET = "pet_id"


def is_nbw() -> Column:
    return F.col("trans_code") == V.NEW_POLICY


def is_renewal() -> Column:
    return F.col("trans_code") == V.RENEW_POLICY


def not_returned() -> Column:
    return F.coalesce(F.col("returned_pet"), F.lit(0)) != 1


@dataclass(frozen=True)
class SumOf:
    name: str
    value: Column


@dataclass(frozen=True)
class DistinctPets:
    name: str
    condition: Column


@dataclass(frozen=True)
class RowCount:
    name: str = "row_count"


def amount_if(cond: Column | None) -> Column:
    """Amount when the condition holds, else 0 (``CASE ... ELSE 0``)."""
    if cond is None:
        return F.col(AMOUNT)
    return F.when(cond, F.col(AMOUNT)).otherwise(F.lit(0))


def core_measures(row_count: bool = False) -> list:
    """GWP, NBW GWP, renewal GWP, NBW and renewal unique pets."""
    ms = [
        SumOf("gwp", F.col(AMOUNT)),
        SumOf("nbw_gwp", amount_if(is_nbw())),
        SumOf("renewal_gwp", amount_if(is_renewal())),
        DistinctPets("nbw_unique_pets", is_nbw() & not_returned()),
        DistinctPets("renewal_unique_pets", is_renewal() & not_returned()),
    ]
    if row_count:
        ms.append(RowCount())
    return ms


def metric_measures(metric: str) -> list:
    """Amount and pet measure for a drilldown metric: NBW, Renewal, or anything else = Total."""
    if metric == "NBW":
        return [SumOf("gwp", amount_if(is_nbw())), DistinctPets("unique_pets", is_nbw() & not_returned())]
    if metric == "Renewal":
        return [SumOf("gwp", amount_if(is_renewal())), DistinctPets("unique_pets", is_renewal() & not_returned())]
    return [SumOf("gwp", F.col(AMOUNT)), DistinctPets("unique_pets", not_returned())]


def _per_pet(measures: list) -> list[Column]:
    """First stage: partial sums and counts, and a 0/1 flag per distinct measure, per (group, pet)."""
    seen = F.col(PET).isNotNull()
    out = []
    for m in measures:
        if isinstance(m, SumOf):
            out.append(F.sum(m.value).alias(m.name))
        elif isinstance(m, DistinctPets):
            out.append(F.max(F.when(m.condition & seen, F.lit(1)).otherwise(F.lit(0))).alias(m.name))
        else:
            out.append(F.count(F.lit(1)).alias(m.name))
    return out


def _per_group(measures: list) -> list[Column]:
    """Last stage: sums of the sums, and sums of the flags = distinct pets."""
    zero = F.lit(0).cast("bigint")
    return [F.sum(m.name).alias(m.name) if isinstance(m, SumOf)
            else F.coalesce(F.sum(m.name).cast("bigint"), zero).alias(m.name) for m in measures]


def aggregate(df: DataFrame, dims: dict[str, Column] | None, measures: list) -> DataFrame:
    """Evaluate ``measures`` per group of ``dims`` (``None``/empty = one global row).

    The global form returns one row even on empty input (sums null, counts 0).
    """
    dims = dims or {}
    names = list(dims)
    if any(isinstance(m, DistinctPets) for m in measures):
        df = df.groupBy(*[c.alias(n) for n, c in dims.items()], F.col(PET).alias("_pet")).agg(*_per_pet(measures))
        grouped = df.groupBy(*names) if names else df
        return grouped.agg(*_per_group(measures)).select(*names, *[m.name for m in measures])
    grouped = df.groupBy(*[c.alias(n) for n, c in dims.items()]) if dims else df
    return grouped.agg(*_per_pet(measures)).select(*names, *[m.name for m in measures])


def aggregate_sets(df: DataFrame, keys: dict[str, Column], sets: list[list[str]], measures: list) -> DataFrame:
    """``measures`` for several groupings of one scan, with ``gid`` = ``grouping_id(keys)``.

    Each row becomes its keys, its pet and the measures' inputs, is copied over the sets
    inside its map task and summed there per (set, its keys, pet); these sums are shuffled,
    then those per (set, its keys). Empty input gives no rows, also for the set ``()``.
    """
    names = list(keys)
    seen = F.col(PET).isNotNull()
    inputs, per_pet = [], []
    for m in measures:
        if isinstance(m, SumOf):
            inputs.append(m.value.alias(m.name))
            per_pet.append(F.sum(m.name).alias(m.name))
        elif isinstance(m, DistinctPets):
            inputs.append(F.when(m.condition & seen, F.lit(1)).otherwise(F.lit(0)).alias(m.name))
            per_pet.append(F.max(m.name).alias(m.name))
        else:
            per_pet.append(F.count(F.lit(1)).alias(m.name))
    rows = df.select(*[c.alias(n) for n, c in keys.items()], F.col(PET).alias("_pet"), *inputs)
    # the pet is part of every set, so it is the last, always zero bit of the id
    gid = F.shiftright(F.grouping_id(*names, "_pet"), 1).alias("gid")
    pets = rows.groupingSets([[*s, "_pet"] for s in sets], *names, "_pet").agg(*per_pet, gid)
    return (pets.groupBy(*names, "gid").agg(*_per_group(measures))
            .select(*names, *[m.name for m in measures], "gid"))


# ---------------------------------------------------------------------------
# Ratios. Money is decimal; dividing two decimal(20,2) values gives
# decimal(38,18) and an amount by a count decimal(38,20), so rounding half away
# from zero to 6 (resp. 2) places is exact for any realistic magnitude.
# ---------------------------------------------------------------------------

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _names(*xs) -> list[str] | None:
    """Backquoted names when every input is a column name, else None.

    Given names, a helper emits its expression as one SQL text (``F.expr``): the
    same expression as the Column form, built with one JVM call instead of dozens.
    """
    if all(isinstance(x, str) for x in xs):
        return ["`" + x.replace("`", "``") + "`" for x in xs]
    return None


def per_pet(amount: Column | str, pets: Column | str, scale: int | None = 2) -> Column:
    """Average premium: amount / pets, null when pets is 0.

    Rounded (exact decimal, half away from zero) when ``scale`` is given, else an
    unrounded double quotient.
    """
    n = _names(amount, pets)
    if n:
        a, p = n
        if scale is None:
            return F.expr(f"CAST({a} AS DOUBLE) / CASE WHEN {p} != 0 THEN CAST({p} AS DOUBLE) END")
        return F.expr(f"ROUND(CAST({a} AS DECIMAL(20,2)) / CASE WHEN {p} != 0 THEN {p} END, {int(scale)})")
    a, p = _c(amount), _c(pets)
    if scale is None:
        return a.cast("double") / F.when(p != 0, p.cast("double"))
    return F.round(a.cast("decimal(20,2)") / F.when(p != 0, p), scale)


def ratio(num: Column | str, den: Column | str, scale: int | None = 6) -> Column:
    """num / den for amounts, null when den is 0 or null."""
    names = _names(num, den)
    if names:
        a, b = names
        if scale is None:
            return F.expr(f"CAST({a} AS DOUBLE) / CASE WHEN {b} != 0 THEN CAST({b} AS DOUBLE) END")
        return F.expr(f"ROUND(CAST({a} AS DECIMAL(20,2)) / CASE WHEN {b} != 0 THEN CAST({b} AS DECIMAL(20,2)) END, "
                      f"{int(scale)})")
    n, d = _c(num), _c(den)
    if scale is None:
        return n.cast("double") / F.when(d != 0, d.cast("double"))
    return F.round(n.cast("decimal(20,2)") / F.when(d != 0, d.cast("decimal(20,2)")), scale)


def pct_change(current: Column | str, base: Column | str) -> Column:
    """(current - base) / base in double; null when base is null or 0, or current is null."""
    names = _names(current, base)
    if names:
        c, b = (f"CAST({x} AS DOUBLE)" for x in names)
        return F.expr(f"CASE WHEN {b} IS NULL OR {b} = 0 THEN CAST(NULL AS DOUBLE) ELSE ({c} - {b}) / {b} END")
    c, b = _c(current).cast("double"), _c(base).cast("double")
    return F.when(b.isNull() | (b == 0), F.lit(None).cast("double")).otherwise((c - b) / b)


def step_change(current: Column | str, previous: Column | str) -> Column:
    """Row-to-row change ``current / previous - 1`` in double; null when previous is 0 or null."""
    c, p = _c(current).cast("double"), _c(previous).cast("double")
    return c / F.when(p != 0, p) - F.lit(1.0)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole in double when whole is non-zero (Python truthiness of a number)."""
    names = _names(part, whole)
    if names:
        a, w = (f"CAST({x} AS DOUBLE)" for x in names)
        return F.expr(f"CASE WHEN {w} IS NOT NULL AND {w} != 0 THEN COALESCE({a}, 0.0D) / {w} END")
    a, w = _c(part).cast("double"), _c(whole).cast("double")
    return F.when(w.isNotNull() & (w != 0), F.coalesce(a, F.lit(0.0)) / w)


def as_output(df: DataFrame) -> DataFrame:
    """Result typing: decimals leave the engine as double (money and ratios)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
