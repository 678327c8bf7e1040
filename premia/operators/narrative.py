"""Narrative text built from query results: top-N bullet blocks, the templated
management commentary (one row per month, all months in one job), and the
context texts handed to a text-generation service (the service call itself is
out of scope).

Bullet blocks keep the first N rows of a result in its report order: a
distributed top-N (``orderBy().limit(n)``), then only those N lines are ranked
and joined in order. The monthly commentary covers every month in one job: the
monthly KPIs meet their prior-month and prior-year values through equi-joins of
one-row-per-month frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as FM
from ..functions import measures as M
from ..plans.period import Period
from . import kpi as K
from . import rollup as R

# FIXED VALUES — text of the bullet blocks, fallbacks and templates.
FALLBACK_STATES = "No state data available."
FALLBACK_CHANNELS = "No channel mix data available."
FALLBACK_PRODUCTS = "No product mix data available."
FALLBACK_WEEKS = "No weekly data available."
FALLBACK_GROWTH = "No growth driver data available."
BLOCK_LIMIT = 5

COMMENTARY_TEMPLATE = """### {period} Summary

- Total GWP for the month is **{gwp}**, with month-over-month movement of **{mom}** and year-over-year movement of **{yoy}**.
- NBW GWP is **{nbw}**, while Renewal GWP is **{ren}**.
- NBW Unique Pets are **{nbw_pets}**, and Renewal Unique Pets are **{ren_pets}**.
- Average NBW Premium is **{avg_nbw}**, while Average Renewal Premium is **{avg_ren}**.
- Renewal Pet Share currently stands at **{share}** and should be treated as a proxy indicator.

### Management Focus Areas

- Review whether current GWP performance is primarily driven by new business or renewals.
- Review the top states and channel mix to identify concentration and growth drivers.
- Compare actuals plus forecast against the full-year plan to assess expected finish."""

COMMENTARY_CONTEXT_TEMPLATE = """You are an FP&A analyst writing a concise executive monthly management commentary.

Write a polished business summary for {period}.
Use a professional finance tone.
Be specific, concise, and decision-oriented.
Do not mention synthetic data in the main bullets.
Do not invent metrics that are not provided.
Do not use emojis.
Prefer short paragraphs or bullets.

Available KPIs:
- Total GWP: {gwp}
- GWP MoM %: {mom}
- GWP YoY %: {yoy}
- GWP vs Plan %: {vs_plan}
- NBW GWP: {nbw}
- NBW vs Plan %: {nbw_vs_plan}
- Renewal GWP: {ren}
- Renewal vs Plan %: {ren_vs_plan}
- NBW Unique Pets: {nbw_pets}
- Renewal Unique Pets: {ren_pets}
- Avg NBW Premium: {avg_nbw}
- Avg Renewal Premium: {avg_ren}
- Renewal Pet Share: {share}

Top states:
{states}

Channel mix:
{channels}

Write the response in this structure:
1. Executive Summary
2. Key Drivers
3. Management Focus Areas

Keep it short enough for a management-call prep note."""

ASSISTANT_ROLES = [
    ("variance", "You are a Variance Assistant. Focus on explaining variance versus plan, mix, and major drivers."),
    ("weekly", "You are a Weekly Performance Assistant. Focus on week-over-week movement, pacing, and short-term shifts."),
    ("growth", "You are a Growth Drivers Assistant. Focus on states, channels, products, and acquisition/renewal mix."),
    ("management", "You are a Management Call Assistant. Focus on executive-level summary, focus areas, risks, and next questions."),
]
ASSISTANT_DEFAULT_ROLE = "You are a finance decision-support assistant."
ASSISTANT_QUESTIONS = [
    ("variance", "Why is this period above or below plan?"),
    ("weekly", "What changed week over week?"),
    ("growth", "Which channels are driving growth?"),
    ("management", "Summarize this period for leadership."),
]

ASSISTANT_TEMPLATE = """{role}

Answer the user's question using only the supplied business context.
Be concise, practical, and business-oriented.
Do not invent facts.
If the data is insufficient, say so clearly.

Selected month:
{period}

User question:
{question}

KPI snapshot:
- Total GWP: {gwp}
- GWP MoM %: {mom}
- GWP YoY %: {yoy}
- GWP vs Plan %: {vs_plan}
- NBW GWP: {nbw}
- Renewal GWP: {ren}
- NBW Unique Pets: {nbw_pets}
- Renewal Unique Pets: {ren_pets}
- Avg NBW Premium: {avg_nbw}
- Avg Renewal Premium: {avg_ren}
- NBW Mix %: {nbw_mix}
- Renewal Mix %: {ren_mix}
- Renewal Pet Share: {share}

Weekly performance:
{weeks}

Top states:
{states}

Channel mix:
{channels}

Product mix:
{products}

Growth drivers:
{growth}

Plan comparison context:
- {base_year} Actual total: {fy_actual}
- {plan_year} Plan total: {fy_plan}
- {plan_year} Actual + Forecast total: {fy_af}

Respond with:
1. Direct Answer
2. Supporting Drivers
3. Recommended Follow-up

Keep it crisp."""


def _py_str(c: Column | str) -> Column:
    """Python ``str()`` of a value inside an f-string: null renders as ``None``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` holes as one ``concat`` of literals and columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


# ---------------------------------------------------------------------------
# X11 — bullet blocks
# ---------------------------------------------------------------------------

def state_line() -> Column:
    return F.concat(F.lit("- "), _py_str("state"), F.lit(": current GWP "), FM.fmt_currency("current_gwp"),
                    F.lit(", YoY "), FM.fmt_pct("yoy_pct"), F.lit(", share "), FM.fmt_pct("share_pct"))


def channel_line() -> Column:
    return F.concat(F.lit("- "), _py_str("iph_channel_5"), F.lit(": GWP "), FM.fmt_currency("gwp"),
                    F.lit(", share "), FM.fmt_pct("share_pct"))


def product_line() -> Column:
    return F.concat(F.lit("- "), _py_str("product"), F.lit(": GWP "), FM.fmt_currency("gwp"),
                    F.lit(", share "), FM.fmt_pct("share_pct"))


def week_line() -> Column:
    return F.concat(F.lit("- Week "), FM.fmt_date("week_start"), F.lit(": GWP "), FM.fmt_currency("gwp"),
                    F.lit(", NBW "), FM.fmt_currency("nbw_gwp"), F.lit(", Renewal "), FM.fmt_currency("renewal_gwp"),
                    F.lit(", NBW mix "), FM.fmt_pct("nbw_mix_pct"), F.lit(", Renewal mix "),
                    FM.fmt_pct("renewal_mix_pct"))


def growth_line() -> Column:
    return F.concat(F.lit("- "), _py_str("iph_channel_5"), F.lit(": total GWP "), FM.fmt_currency("total_gwp"),
                    F.lit(", NBW GWP "), FM.fmt_currency("nbw_gwp"), F.lit(", Renewal GWP "),
                    FM.fmt_currency("renewal_gwp"), F.lit(", NBW mix "), FM.fmt_pct("nbw_mix_pct"))


def lines_block(result: DataFrame, order: list[Column], line: Column, fallback: str,
                limit: int = BLOCK_LIMIT, name: str = "text") -> DataFrame:
    """One row: the first ``limit`` rows of ``result`` (in ``order``) as bullet lines
    joined by newlines, or ``fallback`` when the result is empty."""
    top = result.orderBy(*order).limit(limit)
    ranked = top.select(F.row_number().over(Window.orderBy(*order)).alias("rn"), line.alias("line"))
    joined = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("rn", "line"))),
                                            lambda x: x.getField("line")))
    return ranked.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(fallback)).alias(name))


def _order(value: str, key: str | None) -> list[Column]:
    cols = [F.desc_nulls_first(value)]
    return cols + [F.asc_nulls_first(key)] if key else [F.asc_nulls_first(value)]


BLOCK_KINDS = ["states", "channels", "products", "weeks", "growth"]


def block(kind: str, fact: DataFrame, period: Period, top_n: int = 10, refresh=None) -> DataFrame:
    """One one-row bullet block (states, channels, products, weeks or growth) for a period.

    With a ``RangeRefresh`` of the period the underlying result comes from its one
    grouping-sets scan; without one, the block runs its own operator.
    """
    if kind == "states":
        res = refresh.top_states(top_n) if refresh else R.top_states(fact, period, top_n, with_prior_year=False)
        return lines_block(res, _order("current_gwp", "state"), state_line(), FALLBACK_STATES, name=kind)
    if kind == "channels":
        res = refresh.channel_mix() if refresh else R.channel_mix(fact, period)
        return lines_block(res, _order("gwp", "iph_channel_5"), channel_line(), FALLBACK_CHANNELS, name=kind)
    if kind == "products":
        res = refresh.product_mix() if refresh else R.product_mix(fact, period)
        return lines_block(res, _order("gwp", "product"), product_line(), FALLBACK_PRODUCTS, name=kind)
    if kind == "weeks":
        res = refresh.weekly_performance() if refresh else R.weekly_performance(fact, period)
        return lines_block(res, [F.asc_nulls_first("week_start")], week_line(), FALLBACK_WEEKS, name=kind)
    if kind == "growth":
        res = refresh.growth_drivers() if refresh else R.growth_drivers(fact, period)
        return lines_block(res, _order("total_gwp", "iph_channel_5"), growth_line(), FALLBACK_GROWTH, name=kind)
    raise ValueError(f"Unknown block: {kind}")


def blocks(fact: DataFrame, period: Period, top_n: int = 10, refresh=None) -> dict[str, DataFrame]:
    """The five one-row blocks for a period."""
    return {k: block(k, fact, period, top_n, refresh) for k in BLOCK_KINDS}


# ---------------------------------------------------------------------------
# X12 — templated commentary for every month
# ---------------------------------------------------------------------------

def kpi_by_month(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Monthly KPIs for all months with prior-month and prior-year GWP, changes and
    renewal pet share. Prior values are date lookups (equi-joins of the monthly
    rows with themselves shifted), so a missing month gives null."""
    monthly = R.monthly_kpis(fact, monthly=monthly)
    prev = monthly.select(F.add_months("month_start", 1).alias("month_start"), F.col("gwp").alias("prev_gwp"))
    py = monthly.select(F.add_months("month_start", 12).alias("month_start"), F.col("gwp").alias("py_gwp"))
    return (monthly.join(prev, "month_start", "left").join(py, "month_start", "left")
            .select("*", M.pct_change("gwp", "prev_gwp").alias("gwp_mom_pct"),
                    M.pct_change("gwp", "py_gwp").alias("gwp_yoy_pct"),
                    K._pet_share().alias("renewal_pet_share")))


def _kpi_values() -> dict[str, Column]:
    return {
        "gwp": FM.fmt_currency("gwp"), "mom": FM.fmt_pct("gwp_mom_pct"), "yoy": FM.fmt_pct("gwp_yoy_pct"),
        "nbw": FM.fmt_currency("nbw_gwp"), "ren": FM.fmt_currency("renewal_gwp"),
        "nbw_pets": FM.fmt_number("nbw_unique_pets"), "ren_pets": FM.fmt_number("renewal_unique_pets"),
        "avg_nbw": FM.fmt_currency("avg_nbw_premium"), "avg_ren": FM.fmt_currency("avg_renewal_premium"),
        "share": FM.fmt_pct("renewal_pet_share"),
    }


def monthly_commentary(fact: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """(month_start, commentary): the templated summary for every month."""
    k = kpi_by_month(fact, monthly)
    vals = _kpi_values()
    vals["period"] = FM.month_display("month_start")
    return k.select("month_start", fill(COMMENTARY_TEMPLATE, vals).alias("commentary")).orderBy("month_start")


# ---------------------------------------------------------------------------
# X13 / X14 — context texts for a period
# ---------------------------------------------------------------------------

def _one_row_frames(frames: list[DataFrame]) -> DataFrame:
    return K.one_row(*frames)


def _refresh_for(fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period, refresh):
    from .refresh import RangeRefresh
    return refresh if refresh is not None else RangeRefresh(fact, plan, forecast, period)


def commentary_context(fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period,
                       period_display: str, refresh=None) -> DataFrame:
    """The commentary prompt for a period: range KPIs plus top-state and channel blocks,
    all taken from one grouping-sets scan of the period."""
    r = _refresh_for(fact, plan, forecast, period, refresh)
    b = blocks(fact, period, refresh=r)
    row = _one_row_frames([r.kpi_snapshot(), b["states"], b["channels"]])
    return row.select(commentary_text(F.lit(period_display)).alias("context"))


def commentary_text(display: Column) -> Column:
    """The commentary prompt of a row with range KPIs and the state and channel blocks."""
    vals = _kpi_values()
    vals.update({
        "period": display, "vs_plan": FM.fmt_pct("gwp_vs_plan_pct"),
        "nbw_vs_plan": FM.fmt_pct("nbw_vs_plan_pct"), "ren_vs_plan": FM.fmt_pct("renewal_vs_plan_pct"),
        "states": F.col("states"), "channels": F.col("channels"),
    })
    return fill(COMMENTARY_CONTEXT_TEMPLATE, vals)


def assistant_context(fact: DataFrame, plan: DataFrame, forecast: DataFrame, period: Period,
                      period_display: str, base_year: int, plan_year: int,
                      questions: list[tuple[str, str]] | None = None, refresh=None,
                      monthly: DataFrame | None = None) -> DataFrame:
    """One context text per (assistant type, question): role instruction, question,
    range KPIs, five bullet blocks and full-year plan-comparison totals."""
    from . import budget as B
    from . import transforms as X
    r = _refresh_for(fact, plan, forecast, period, refresh)
    b = blocks(fact, period, refresh=r)
    fy = X.full_year_totals(B.plan_comparison(fact, plan, forecast, base_year, plan_year, monthly),
                            base_year, plan_year)
    row = _one_row_frames([r.kpi_snapshot(), *b.values(), fy])
    # The questions are parameters: exploded from a literal array into the one
    # context row (a generator, no join).
    qs = F.array(*[F.struct(F.lit(t).alias("assistant_type"), F.lit(q).alias("question"))
                   for t, q in (questions or ASSISTANT_QUESTIONS)])
    row = row.select("*", F.inline(qs))
    return row.select("assistant_type", "question",
                      assistant_text(F.lit(period_display), base_year, plan_year).alias("context"))


def assistant_text(display: Column, base_year: int, plan_year: int) -> Column:
    """The assistant's context of a row with question, range KPIs, blocks and full-year totals."""
    role = F.lit(ASSISTANT_DEFAULT_ROLE)
    for t, text in reversed(ASSISTANT_ROLES):
        role = F.when(F.col("assistant_type") == t, F.lit(text)).otherwise(role)
    vals = _kpi_values()
    vals.update({
        "role": role, "question": F.col("question"), "period": display,
        "vs_plan": FM.fmt_pct("gwp_vs_plan_pct"),
        "nbw_mix": FM.fmt_pct("nbw_mix_pct"), "ren_mix": FM.fmt_pct("renewal_mix_pct"),
        "weeks": F.col("weeks"), "states": F.col("states"), "channels": F.col("channels"),
        "products": F.col("products"), "growth": F.col("growth"),
        "base_year": F.lit(str(base_year)), "plan_year": F.lit(str(plan_year)),
        "fy_actual": FM.fmt_currency(f"fy_{base_year}_actual"), "fy_plan": FM.fmt_currency(f"fy_{plan_year}_plan"),
        "fy_af": FM.fmt_currency(f"fy_{plan_year}_actual_plus_forecast"),
    })
    return fill(ASSISTANT_TEMPLATE, vals)
