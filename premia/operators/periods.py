"""Range results for a whole table of periods, from one scan of the fact.

``periods`` has one row per period: ``period_id``, ``start_date``, ``end_date`` (inclusive;
periods may overlap, repeat or be empty). The starts and the days after the ends cut the
calendar into intervals that no period divides. The fact's rows are shuffled once, by pet,
and reduced to one per (dimension, group, pet, interval); a pet's earlier interval is found
by a window over its own few rows in the same task, and pets are then counted per (group,
interval, earlier interval). A pet counts in a period at the row whose earlier interval lies
before the period's first, so distinct counts are exact although the fact's rows are never
multiplied by the number of periods: what meets the periods, by equality of intervals, is bounded by groups x
intervals squared.

Windows without a partition key run over calendar days only; other windows are per period
and run over its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.dims import dimension
from ..plans.period import Period
from ..session import new_table_path
from . import budget as B
from . import kpi as K
from . import narrative as N
from . import transforms as X

ID = "period_id"
# dimension sets: label -> dimension of the registry (None: all rows)
SETS = {"total": None, "state": "State", "channel": "Channel", "product": "Product", "week": "Week", "month": "Month"}
_SUMS = ["gwp", "nbw_gwp", "renewal_gwp"]
_PETS = ["nbw_unique_pets", "renewal_unique_pets"]


def _numbered_days(periods: DataFrame, first, last) -> DataFrame:
    """Every day from the first start to the last end with the number of its interval (from 1)."""
    spark = periods.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    cuts = periods.select(F.col("start_date").alias("day")).union(
        periods.select(F.date_add("end_date", 1))).distinct().withColumn("cut", F.lit(1))
    return days.join(cuts, "day", "left").select("day", F.count("cut").over(Window.orderBy("day")).alias("e"))


# Rows that one task takes on average: a row meets six sets, so this bounds its hash maps and sorts at any size.
ROWS_PER_TASK = 200_000


def period_cells(fact: DataFrame, days: DataFrame, sets: dict[str, str | None], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(set, grp, e, prev, sums, pet counts)``: sums at prev -1, pets by the interval of their previous row (0: none).

    Rows are shuffled once, by their pet and before the sets are made; a task then has all
    rows of its pets, so neither the grouping nor the window moves them again. Rows without
    a pet count none and are spread by their salt.
    """
    src = fact.join(F.broadcast(days), fact.report_date == days.day)      # one row per calendar day
    core = M.core_measures()
    dims = {f"_{k}": (dimension(d, fact) if d else F.lit(None)).cast("string") for k, d in sets.items()}
    keys = F.array(*[F.struct(F.lit(k).alias("set"), F.col(f"_{k}").alias("grp")) for k in sets])
    seen = F.col(M.PET).isNotNull()
    salt = F.when(seen, F.lit(0)).otherwise(F.pmod(F.xxhash64("report_date", M.AMOUNT), F.lit(1024)).cast("int")).alias("_salt")
    inputs = [m.value.alias(m.name) if isinstance(m, M.SumOf)
              else F.when(m.condition & seen, F.lit(1)).otherwise(F.lit(0)).alias(m.name) for m in core]
    pet = [M.PET, "_salt"]
    narrow = src.select("e", *[c.alias(n) for n, c in dims.items()], M.PET, salt, *inputs)
    tasks = max(1, -(-fact.count() // rows_per_task))
    rows = narrow.repartition(tasks, *pet).select("e", *pet, *_SUMS, *_PETS, F.inline(keys))
    base = rows.groupBy("set", "grp", *pet, "e").agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _PETS])
    before = Window.partitionBy("set", "grp", *pet).orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    prev = {c: F.when(F.col(c) == 1, F.coalesce(F.max(F.when(F.col(c) == 1, F.col("e"))).over(before), F.lit(0)))
            for c in _PETS}
    base = base.select("set", "grp", "e", *_SUMS, *[x.alias(f"prev_{c}") for c, x in prev.items()])
    none = {s: F.lit(None).cast(base.schema[s].dataType) for s in _SUMS}

    def cell(at: Column, sums: bool, pets: str | None) -> Column:
        return F.struct(at.cast("long").alias("prev"), *[(F.col(s) if sums else none[s]).alias(s) for s in _SUMS],
                        *[F.lit(int(c == pets)).cast("long").alias(c) for c in _PETS])

    parts = F.array(cell(F.lit(-1), True, None), *[cell(F.col(f"prev_{c}"), False, c) for c in _PETS])
    cells = base.select("set", "grp", "e", F.inline(parts)).where("prev is not null")
    return cells.groupBy("set", "grp", "e", "prev").agg(*[F.sum(c).alias(c) for c in _SUMS + _PETS])


def period_measures(fact: DataFrame, periods: DataFrame, sets: dict[str, str | None] = SETS) -> DataFrame:
    """``(period_id, set, grp, core measures)`` of every period and group with rows in it."""
    periods = periods.select(ID, F.col("start_date").cast("date").alias("start_date"),
                             F.col("end_date").cast("date").alias("end_date"))
    span = periods.agg(F.min("start_date").alias("a"), F.max("end_date").alias("b"),
                       F.count_if(F.expr("start_date is null or end_date is null or start_date > end_date")).alias("bad")).first()
    if span["bad"]:
        raise ValueError("Start Date cannot be after End Date.")
    whole = Period(span["a"], span["b"]) if span["a"] else Period("1970-01-01", "1970-01-01")
    days = _numbered_days(periods, whole.start, whole.end)
    cells = period_cells(whole.filter(fact), days, sets)
    spans = periods.join(days.select(F.col("day").alias("start_date"), F.col("e").alias("a")), "start_date").join(
        days.select(F.col("day").alias("end_date"), F.col("e").alias("b")), "end_date")
    each = spans.select(ID, "a", F.explode(F.sequence("a", "b")).alias("e"))
    return cells.join(each, "e").where("prev < a").groupBy(ID, "set", "grp").agg(
        *[F.sum(c).alias(c) for c in _SUMS + _PETS])


class PeriodReport:
    """All range results for every period of a table; the fact is scanned once, here."""

    def __init__(self, fact: DataFrame, plan: DataFrame, forecast: DataFrame, periods: DataFrame):
        self.plan, self.forecast = plan, forecast
        self.periods = periods.select(ID, F.col("start_date").cast("date").alias("start_date"),
                                      F.col("end_date").cast("date").alias("end_date"))
        spark = fact.sparkSession
        rows = period_measures(fact, self.periods)
        path = new_table_path(spark, "period_measures")
        rows.write.parquet(path)
        self.measures = spark.read.schema(rows.schema).parquet(path)

    def _of(self, kind: str, name: str, typ: str = "string") -> DataFrame:
        return self.measures.where(F.col("set") == kind).drop("set").withColumn("grp", F.col("grp").cast(typ)).withColumnRenamed(
            "grp", name)

    def _budget(self, budget: DataFrame, month: str, amount: str, prefix: str, metrics: list, by_month: bool = False) -> DataFrame:
        """Budget sums of each period's whole months."""
        months = self.periods.select(ID, F.explode(F.expr(
            "sequence(trunc(start_date, 'month'), trunc(end_date, 'month'), interval 1 month)")).alias(month))
        rows = budget.where(F.col("dimension_type") == K.V.TOTAL_DIMENSION).join(months, month)
        keys = [F.col(ID), *([F.col(month).alias("month_start")] if by_month else [])]
        return rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("metric_name") == m, F.col(amount)).otherwise(F.lit(0))).alias(
            f"{prefix}_{s}") for m, s in metrics])

    def kpi_snapshots(self) -> DataFrame:
        """The range KPI snapshot of each period, periods without rows included."""
        row = (self.periods.join(self._of("total", "_all").drop("_all"), ID, "left")
               .join(self._budget(self.plan, "plan_month", "plan_amount", "plan", K.PLAN_METRICS[:5]), ID, "left")
               .join(self._budget(self.forecast, "forecast_month", "forecast_amount", "forecast", K.PLAN_METRICS[:3]), ID, "left"))
        return K.range_snapshot_columns(row, [ID])

    @staticmethod
    def _shares(g: DataFrame, value: str) -> DataFrame:
        total = F.sum(value).over(Window.partitionBy(ID))
        return g.withColumn("_total", total).withColumn("share_pct", M.ratio(value, "_total")).drop("_total")

    @staticmethod
    def _rank(value: str, key: str) -> Column:
        return F.row_number().over(Window.partitionBy(ID).orderBy(F.desc_nulls_first(value), F.asc_nulls_first(key)))

    def top_states(self, top_n: int = 10) -> DataFrame:
        g = self._shares(self._of("state", "state"), "gwp").withColumn("rn", self._rank("gwp", "state")).where(
            F.col("rn") <= top_n)
        return M.as_output(g.select(ID, "state", F.round("gwp", 2).alias("current_gwp"),
                                    F.lit(None).cast("double").alias("py_gwp"), F.lit(None).cast("double").alias("yoy_pct"),
                                    "share_pct"))

    def mix(self, kind: str, name: str) -> DataFrame:
        g = self._shares(self._of(kind, name), "gwp")
        return M.as_output(g.select(ID, name, F.round("gwp", 2).alias("gwp"), "share_pct"))

    def channel_mix(self) -> DataFrame:
        return self.mix("channel", "iph_channel_5")

    def product_mix(self) -> DataFrame:
        return self.mix("product", "product")

    def weekly_performance(self) -> DataFrame:
        """Weeks clipped to each period, with the change from the period's previous present week."""
        core = _SUMS + _PETS
        g = self._of("week", "week_start", "date").select(
            ID, "week_start", *core,
            M.per_pet("nbw_gwp", "nbw_unique_pets").alias("avg_nbw_premium"),
            M.per_pet("renewal_gwp", "renewal_unique_pets").alias("avg_renewal_premium"),
            M.ratio("nbw_gwp", "gwp").alias("nbw_mix_pct"), M.ratio("renewal_gwp", "gwp").alias("renewal_mix_pct"))
        w = Window.partitionBy(ID).orderBy(F.asc_nulls_first("week_start"))
        return M.as_output(g.select("*", *[M.step_change(c, F.lag(c).over(w)).alias(f"{c}_wow_pct") for c in core]))

    def growth_drivers(self) -> DataFrame:
        return M.as_output(self._of("channel", "iph_channel_5").select(
            ID, "iph_channel_5", F.round("gwp", 2).alias("total_gwp"), F.round("nbw_gwp", 2).alias("nbw_gwp"),
            F.round("renewal_gwp", 2).alias("renewal_gwp"), *_PETS, M.ratio("nbw_gwp", "gwp").alias("nbw_mix_pct"),
            M.ratio("renewal_gwp", "gwp").alias("renewal_mix_pct")))

    def actual_plan_forecast(self) -> DataFrame:
        """Each period's months of actual, plan or forecast."""
        actual = self._of("month", "month_start", "date").select(
            ID, "month_start", *[F.col(s).alias(f"actual_{s}") for _, s in B.FIVE])
        p = self._budget(self.plan, "plan_month", "plan_amount", "plan", B.FIVE, True)
        f = self._budget(self.forecast, "forecast_month", "forecast_amount", "forecast", B.FIVE, True)
        return B.range_months(actual, p, f, [ID])

    # -- texts ---------------------------------------------------------------------
    def _block(self, result: DataFrame, order: list[Column], line: Column, fallback: str, name: str) -> DataFrame:
        """Each period's first lines as one text."""
        top = result.withColumn("rn", F.row_number().over(Window.partitionBy(ID).orderBy(*order))).where(
            F.col("rn") <= N.BLOCK_LIMIT)
        lines = F.transform(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"])
        text = top.groupBy(ID).agg(F.concat_ws("\n", lines).alias(name))
        return self.periods.select(ID).join(text, ID, "left").select(
            ID, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(fallback)).alias(name))

    def block(self, kind: str) -> DataFrame:
        """``(period_id, text)``: the bullet block of each period (states, channels, products, weeks or growth)."""
        kinds = {
            "states": (self.top_states, N._order("current_gwp", "state"), N.state_line, N.FALLBACK_STATES),
            "channels": (self.channel_mix, N._order("gwp", "iph_channel_5"), N.channel_line, N.FALLBACK_CHANNELS),
            "products": (self.product_mix, N._order("gwp", "product"), N.product_line, N.FALLBACK_PRODUCTS),
            "weeks": (self.weekly_performance, [F.asc_nulls_first("week_start")], N.week_line, N.FALLBACK_WEEKS),
            "growth": (self.growth_drivers, N._order("total_gwp", "iph_channel_5"), N.growth_line, N.FALLBACK_GROWTH),
        }
        if kind not in kinds:
            raise ValueError(f"Unknown block: {kind}")
        result, order, line, fallback = kinds[kind]
        return self._block(result(), order, line(), fallback, kind)

    def commentary_contexts(self) -> DataFrame:
        """``(period_id, context)``: the commentary prompt of each period, named by its end month."""
        rows = self.kpi_snapshots().join(self.periods, ID)
        for kind in ("states", "channels"):
            rows = rows.join(self.block(kind), ID)
        return rows.select(ID, N.commentary_text(N.FM.month_display("end_date")).alias("context"))

    def assistant_contexts(self, questions: DataFrame, comparison: DataFrame, base_year: int, plan_year: int) -> DataFrame:
        """One context per row of ``questions(period_id, assistant_type, question)``; ``comparison`` is the plan comparison."""
        totals = X.full_year_totals(comparison, base_year, plan_year)
        fy = totals.select(F.struct(*totals.columns).alias("t")).scalar()
        rows = self.kpi_snapshots().join(self.periods, ID)
        for kind in N.BLOCK_KINDS:
            rows = rows.join(self.block(kind), ID)
        rows = rows.withColumn("_fy", fy).select("*", "_fy.*")
        rows = rows.join(questions.select(ID, "assistant_type", "question"), ID)
        display = F.concat(F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string"))
        return rows.select(ID, "assistant_type", "question", N.assistant_text(display, base_year, plan_year).alias("context"))


def month_pairs(spark, first: str, last: str) -> DataFrame:
    """A period for every pair of a first and a last month between two months."""
    first, last = F.lit(first).cast("date"), F.lit(last).cast("date")
    month = F.expr("interval 1 month")
    pairs = spark.range(1).select(F.explode(F.sequence(first, last, month)).alias("start_date")).select(
        "start_date", F.explode(F.sequence(F.col("start_date"), last, month)).alias("m"))
    return pairs.select(F.concat(F.date_format("start_date", "yyyy-MM"), F.lit(".."), F.date_format("m", "yyyy-MM")).alias(ID),
                        "start_date", F.last_day("m").alias("end_date"))
