"""Queries along securities and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.operators import cross, series
from paneloom.plans.base import day, ds, filings, market, panel, query, r, rs, with_
from paneloom.plans.cross_section import rank_sql, scaled_sql, state_frame  # noqa: F401

_W = "WINDOW w AS (PARTITION BY permno ORDER BY eom)"
_MN = "(year({0}) * 12 + month({0}))"


def mn(c: str) -> str:
    return _MN.format(c)


@query(with_(f"""SELECT permno, {ds('eom')} AS eom,
  {rs('CASE WHEN ' + mn('lag(eom, 1) OVER w') + ' = ' + mn('eom') + ' - 1 THEN me / (lag(me) OVER w) - 1 END')} AS me_growth,
  {rs('CASE WHEN ' + mn('lag(eom, 12) OVER w') + ' = ' + mn('eom') + ' - 12 THEN lag(ret, 12) OVER w END')} AS ret_year_ago,
  {rs('CASE WHEN ' + mn('lead(eom, 1) OVER w') + ' = ' + mn('eom') + ' + 1 THEN lead(ret) OVER w END')} AS ret_next FROM panel {_W}""", "panel"))
def exact_shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Values exactly one and twelve months before and one month after; a gap gives null."""
    rows = panel(spark, folder, "me", "ret")
    return rows.select("permno", day("eom").alias("eom"), r(F.col("me") / series.shift_exact("me", ["permno"], 1) - 1).alias("me_growth"), r(series.shift_exact("ret", ["permno"], 12)).alias("ret_year_ago"), r(series.shift_exact("ret", ["permno"], -1)).alias("ret_next"))


@query(with_(f"""SELECT permno, {ds('eom')} AS eom, {rs('CASE WHEN count(ret) OVER t >= 6 THEN product(1 + ret) OVER t END - 1')} AS compounded,
  {rs('CASE WHEN count(ret) OVER t >= 6 THEN stddev_samp(ret) OVER t END')} AS deviation, {rs('avg(ret) OVER p')} AS past_mean
FROM panel WINDOW t AS (PARTITION BY permno ORDER BY eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), p AS (PARTITION BY permno ORDER BY eom ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""", "panel"))
def trailing_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve rows with the current one, at least six known; and the twelve before the current one."""
    rows = panel(spark, folder, "ret")
    return rows.select("permno", day("eom").alias("eom"), r(series.trailing_compound("ret", ["permno"])).alias("compounded"), r(series.trailing_std("ret", ["permno"])).alias("deviation"), r(series.past_mean("ret", ["permno"])).alias("past_mean"))


_MKT = """mkt AS (SELECT eom, sum(ret * w) / sum(CASE WHEN ret IS NOT NULL THEN w END) AS mkt FROM (SELECT *, coalesce(CASE WHEN lag(eom) OVER v = last_day(eom - INTERVAL 1 MONTH) THEN lag(me) OVER v END, me) AS w
  FROM panel WINDOW v AS (PARTITION BY permno ORDER BY eom)) GROUP BY eom)"""


@query(with_(f"""{_MKT}, j AS (SELECT p.permno, p.eom, p.ret, m.mkt FROM panel p JOIN mkt m USING (eom))
SELECT permno, {ds('eom')} AS eom, {rs('CASE WHEN count(ret + mkt) OVER f = 12 AND max(' + mn('eom') + ') OVER f = ' + mn('eom') + ' + 12 THEN covar_pop(ret, mkt) OVER f / nullif(var_pop(mkt) OVER f, 0) END', 5)} AS forward_beta,
  {rs('CASE WHEN count(ret + mkt) OVER b = 12 THEN covar_samp(ret, mkt) OVER b / nullif(var_samp(mkt) OVER b, 0) END', 5)} AS trailing_beta
FROM j WINDOW f AS (PARTITION BY permno ORDER BY eom ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), b AS (PARTITION BY permno ORDER BY eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "panel"))
def market_betas(spark: SparkSession, folder: str) -> DataFrame:
    """Slopes on the market over the next twelve months (all there, no gap) and over the last twelve rows."""
    rows = beta_frame(spark, folder)
    return rows.select("permno", day("eom").alias("eom"), r("forward_beta", 5).alias("forward_beta"), r(series.rolling_beta("ret", "mkt_ret", ["permno"]), 5).alias("trailing_beta"))


def beta_frame(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    state = state_frame(spark, folder).select("eom", "mkt_ret")
    rows = panel(spark, folder, *dict.fromkeys(["ret", *columns])).join(state, "eom")
    return series.forward_beta(rows, "permno", "ret", "mkt_ret")


@query(with_(f"""z AS (SELECT permno, eom, coalesce((ret_12_1 - avg(ret_12_1) OVER w) / nullif(stddev_pop(ret_12_1) OVER w, 0), 0) AS z FROM panel WINDOW w AS (PARTITION BY eom)),
n AS (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY eom) AS i, CASE WHEN {mn('lag(eom) OVER (PARTITION BY permno ORDER BY eom)')} = {mn('eom')} - 1 THEN false ELSE true END AS starts FROM z),
s AS (SELECT * FROM (WITH RECURSIVE e AS (SELECT permno, eom, i, z AS smooth FROM n WHERE i = 1 UNION ALL
  SELECT n.permno, n.eom, n.i, CASE WHEN n.starts THEN n.z ELSE 0.5 * n.z + 0.5 * e.smooth END FROM n JOIN e ON n.permno = e.permno AND n.i = e.i + 1) SELECT * FROM e))
SELECT permno, {ds('eom')} AS eom, {rs('smooth')} AS smooth FROM s""", "panel"))
def ema_gap_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Exponential smoothing of a monthly z-score that starts anew after a gap."""
    rows = panel(spark, folder, "ret_12_1").withColumn("z", cross.zscore("ret_12_1", ["eom"], population=True))
    return series.ema_gap_reset(rows, ["permno"], "z", 0.5).select("permno", day("eom").alias("eom"), r("smooth").alias("smooth"))


@query(with_(f"""m AS (SELECT month, total, product(1 + total) OVER w AS wealth, sum(ln(1 + total)) OVER w AS logs FROM (SELECT CAST(eom AS DATE) AS month, sp500_ret AS total FROM market_monthly) WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT {ds('month')} AS month, {rs('wealth')} AS wealth, {rs('wealth / greatest(max(wealth) OVER u, 1) - 1')} AS drawdown, {rs('logs')} AS log_wealth, {rs('logs - max(logs) OVER u')} AS log_drawdown
FROM m WINDOW u AS (ORDER BY month ROWS UNBOUNDED PRECEDING)""", "panel"))
def drawdowns(spark: SparkSession, folder: str) -> DataFrame:
    """Wealth and losses from its peak, with a floor at the start and in logs without one."""
    rows = market(spark, folder).select("month", F.col("sp500_ret").alias("total"))
    rows = series.with_log_drawdown(series.with_drawdown(rows, "total", [], "month"), "total", [], "month")
    return rows.select(day("month").alias("month"), *[r(c).alias(c) for c in ("wealth", "drawdown", "log_wealth", "log_drawdown")])


@query(f"""WITH x AS (SELECT CAST(eom AS DATE) AS month, sp500_exret AS x FROM market_monthly)
SELECT {ds('a.month')} AS month, {rs('median(b.x)')} AS past_median, {rs('CASE WHEN count(*) > 0 AND any_value(n.k) >= 12 THEN any_value(n.m) END')} AS rolling_mean, {rs('CASE WHEN any_value(n.k) >= 12 THEN any_value(n.m) / nullif(any_value(n.s), 0) * sqrt(12) END', 5)} AS rolling_ratio
FROM x a LEFT JOIN x b ON b.month < a.month JOIN (SELECT month, count(x) OVER t AS k, avg(x) OVER t AS m, stddev_samp(x) OVER t AS s FROM x WINDOW t AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) n ON n.month = a.month GROUP BY a.month""")
def expanding_and_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Median of all earlier months; mean and annualised ratio of full twelve-month windows."""
    rows = series.expanding_past_median(market(spark, folder).select("month", F.col("sp500_exret").alias("x")), "month", "x", "past_median")
    w = Window.orderBy("month").rowsBetween(-11, 0)
    full = F.count("x").over(w) >= 12
    mean, sd = F.avg("x").over(w), F.stddev_samp("x").over(w)
    return rows.select(day("month").alias("month"), r("past_median").alias("past_median"), r(F.when(full, mean)).alias("rolling_mean"), r(F.when(full, mean / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(12.0))), 5).alias("rolling_ratio"))


_TYPES = ("1.01", "2.02", "5.02", "7.01", "8.01", "9.01")
_CODE = "regexp_extract(lower(label), '(\\d{1,2}\\.\\d{2})', 1)"
_ITEMS = f"items AS (SELECT permno, eom, {_CODE} AS code FROM (SELECT permno, eom, unnest(items) AS label FROM filings))"


@query(with_(f"""{_ITEMS},
c AS (SELECT code, eom, count(*) AS n FROM items WHERE code IN {_TYPES} GROUP BY ALL),
spine AS (SELECT code, last_day(CAST(unnest(generate_series((SELECT date_trunc('month', min(eom)) FROM c), (SELECT date_trunc('month', max(eom)) FROM c), INTERVAL 1 MONTH)) AS DATE)) AS eom FROM (SELECT DISTINCT code FROM c)),
d AS (SELECT s.code, s.eom, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN c ON s.code = c.code AND s.eom = c.eom),
b AS (SELECT *, coalesce(avg(n) OVER (PARTITION BY code ORDER BY eom ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) AS base FROM d)
SELECT code, {ds('eom')} AS eom, n, {rs('(n - base) / sqrt(base + 1)')} AS wave FROM b""", "filings"))
def wave_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly counts of item types on a full calendar, against the mean of the past twelve months."""
    from paneloom.plans.events import item_rows

    counts = item_rows(spark, folder, _TYPES).groupBy("code", "eom").agg(F.count(F.lit(1)).alias("n"))
    dense = series.densify_months(counts, ["code"], "eom", "n")
    return dense.select("code", day("eom").alias("eom"), "n", r(series.surprise("n", ["code"])).alias("wave"))


@query(with_(f"SELECT a.permno, {ds('a.eom')} AS eom FROM panel a WHERE EXISTS (SELECT 1 FROM panel b WHERE b.permno = a.permno AND b.eom = last_day(a.eom + INTERVAL 1 DAY))", "panel"))
def retained_next_month(spark: SparkSession, folder: str) -> DataFrame:
    return series.retained(panel(spark, folder), "permno").select("permno", day("eom").alias("eom"))
