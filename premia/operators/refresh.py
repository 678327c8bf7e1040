"""One dashboard refresh over a date range from a single scan of the fact.

The range-driven results of a refresh — KPI snapshot, weekly performance, top
states, channel and product mix, growth drivers, every drilldown and metric
drilldown — all group the same period's rows by one dimension (or none). One
``GROUPING SETS`` aggregate computes all of them in one pass: (), week, state,
channel, product, vendor, each with the core sums and three distinct pet counts
(per grouping set, never added across sets; a row's copies are summed in its map task
before the shuffle). That aggregate has
one row per group, so it is written once to the shared folder; each result is then
a small projection of it, finished by the same code as the single-query operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.dims import dimension
from ..plans.period import Period
from ..session import new_table_path
from . import kpi as K
from . import rollup as R

# grouping key column -> dimension name
KEYS = [("week_start", "Week"), ("state", "State"), ("iph_channel_5", "Channel"), ("product", "Product"),
        ("vendor", "Vendor")]


class RangeRefresh:
    def __init__(self, fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period,
                 materialize: bool = True):
        self.plan, self.forecast, self.period = plan, forecast, period
        src = period.filter(fact)
        keys = [k for k, _ in KEYS]
        measures = [*M.core_measures(), M.DistinctPets("unique_pets", M.not_returned())]
        g = M.aggregate_sets(src, {k: dimension(d, src) for k, d in KEYS}, [[]] + [[k] for k in keys], measures)
        if materialize:
            path = new_table_path(fact.sparkSession, "refresh")
            g.write.mode("overwrite").parquet(path)
            g = fact.sparkSession.read.schema(g.schema).parquet(path)
        self.groups = g
        self._n = len(keys)

    def _gid(self, key: str | None) -> int:
        full = (1 << self._n) - 1
        if key is None:
            return full
        i = [k for k, _ in KEYS].index(key)
        return full - (1 << (self._n - 1 - i))

    def rows(self, key: str | None, alias: str | None = None) -> DataFrame:
        """The rows of one grouping set: the key (renamed) plus all measures."""
        g = self.groups.where(F.col("gid") == self._gid(key))
        measures = ["gwp", "nbw_gwp", "renewal_gwp", "nbw_unique_pets", "renewal_unique_pets", "unique_pets"]
        cols = ([F.col(key).alias(alias or key)] if key else []) + [F.col(c) for c in measures]
        return g.select(*cols)

    @staticmethod
    def _key(dim: str) -> str:
        return {d: k for k, d in KEYS}[dim]

    # -- results --------------------------------------------------------------
    def kpi_snapshot(self) -> DataFrame:
        total = self.rows(None).select(*K.CORE)
        return K.range_snapshot_finish(total, self.plan, self.forecast, self.period)

    def weekly_performance(self) -> DataFrame:
        return R.weekly_finish(self.rows("week_start").select("week_start", *K.CORE))

    def top_states(self, top_n: int = 10) -> DataFrame:
        return R.top_states_finish(self.rows("state").select("state", F.col("gwp").alias("current_gwp")),
                                   top_n, with_prior_year=False)

    def channel_mix(self) -> DataFrame:
        return R.mix_finish(self.rows("iph_channel_5").select("iph_channel_5", "gwp"), "iph_channel_5")

    def product_mix(self) -> DataFrame:
        return R.mix_finish(self.rows("product").select("product", "gwp"), "product")

    def growth_drivers(self) -> DataFrame:
        return R.growth_finish(self.rows("iph_channel_5").select("iph_channel_5", *K.CORE))

    def drilldown(self, group_by: str) -> DataFrame:
        return R.drilldown_finish(self.rows(self._key(group_by), "drilldown_group")
                                  .select("drilldown_group", *K.CORE))

    def metric_drilldown(self, metric: str, group_by: str) -> DataFrame:
        gwp, pets = {"NBW": ("nbw_gwp", "nbw_unique_pets"),
                     "Renewal": ("renewal_gwp", "renewal_unique_pets")}.get(metric, ("gwp", "unique_pets"))
        g = self.rows(self._key(group_by), "drilldown_group")
        return R.metric_finish(g.select("drilldown_group", F.col(gwp).alias("gwp"), F.col(pets).alias("unique_pets")))
