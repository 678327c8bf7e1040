"""The range operators as SQL table functions over the registered views.

``drilldown(start, end, dimension)`` and ``metric_drilldown(start, end, metric, dimension)``
take foldable arguments: Spark inlines the body, so the bounds are pushed to the scan and
prune partitions, and only the named dimension is grouped. Distinct pets are counted in two
stages, as in ``measures.aggregate``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import vocab as V

_DIMENSION = """CASE dimension WHEN 'Week' THEN CAST(trunc(report_date, 'week') AS STRING) WHEN 'State' THEN state
  WHEN 'Channel' THEN iph_channel_5 WHEN 'Vendor' THEN {vendor} WHEN 'Product' THEN product
  ELSE raise_error(concat('Invalid drilldown group: ', dimension)) END"""
_IN_RANGE = """report_date BETWEEN start_date AND end_date
  AND report_month BETWEEN trunc(start_date, 'month') AND trunc(end_date, 'month')"""
_KEPT = "coalesce(returned_pet, 0) <> 1 AND pet_id IS NOT NULL"


def _average(amount: str, pets: str) -> str:
    return f"CAST(ROUND(CAST({amount} AS DECIMAL(20,2)) / CASE WHEN {pets} != 0 THEN {pets} END, 2) AS DOUBLE)"


def register_functions(spark: SparkSession, vendor: str = "vendor_5", fact: str = "fact_written_details") -> None:
    """(Re)creates the temporary functions; ``fact`` is a registered view of the fact, partitioned by report month."""
    group = _DIMENSION.format(vendor=f"`{vendor}`")
    new, renew = f"trans_code = '{V.NEW_POLICY}'", f"trans_code = '{V.RENEW_POLICY}'"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION drilldown(start_date DATE, end_date DATE, dimension STRING)
RETURNS TABLE (drilldown_group STRING, actual_gwp DOUBLE, nbw_gwp DOUBLE, renewal_gwp DOUBLE, nbw_unique_pets BIGINT,
  renewal_unique_pets BIGINT, avg_nbw_premium DOUBLE, avg_renewal_premium DOUBLE)
RETURN
  SELECT g, CAST(ROUND(SUM(a), 2) AS DOUBLE), CAST(ROUND(SUM(n), 2) AS DOUBLE), CAST(ROUND(SUM(r), 2) AS DOUBLE),
    SUM(np), SUM(rp), {_average('SUM(n)', 'SUM(np)')}, {_average('SUM(r)', 'SUM(rp)')}
  FROM (
    SELECT {group} AS g, pet_id, SUM(written_amount) AS a, SUM(CASE WHEN {new} THEN written_amount ELSE 0 END) AS n,
      SUM(CASE WHEN {renew} THEN written_amount ELSE 0 END) AS r,
      CAST(MAX(CASE WHEN {new} AND {_KEPT} THEN 1 ELSE 0 END) AS BIGINT) AS np,
      CAST(MAX(CASE WHEN {renew} AND {_KEPT} THEN 1 ELSE 0 END) AS BIGINT) AS rp
    FROM {fact} WHERE {_IN_RANGE} GROUP BY 1, 2)
  GROUP BY g""")
    chosen = f"CASE metric WHEN 'NBW' THEN {new} WHEN 'Renewal' THEN {renew} ELSE true END"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION metric_drilldown(start_date DATE, end_date DATE, metric STRING, dimension STRING)
RETURNS TABLE (drilldown_group STRING, gwp DOUBLE, unique_pets BIGINT, avg_premium DOUBLE, share_pct DOUBLE)
RETURN
  SELECT g, CAST(ROUND(x, 2) AS DOUBLE), p, {_average('x', 'p')},
    CAST(ROUND(CAST(x AS DECIMAL(20,2)) / nullif(CAST(SUM(x) OVER () AS DECIMAL(20,2)), 0), 6) AS DOUBLE)
  FROM (
    SELECT g, SUM(x) AS x, SUM(p) AS p
    FROM (
      SELECT g, pet_id, SUM(x) AS x, MAX(kept) AS p
      FROM (
        SELECT {group} AS g, pet_id, CASE WHEN {chosen} THEN written_amount ELSE 0 END AS x,
          CASE WHEN {chosen} AND {_KEPT} THEN 1L ELSE 0L END AS kept
        FROM {fact} WHERE {_IN_RANGE})
      GROUP BY g, pet_id)
    GROUP BY g)""")
