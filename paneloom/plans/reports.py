"""Queries over a long/short book: ledger, exposures, performance and regression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.operators import cross, report, series, stats
from paneloom.plans.base import CHARACTERISTICS, book, day, ds, filings, market, panel, query, r, rs, with_
from paneloom.plans.cross_section import rank_sql, scaled_sql

SIDE = ("permno", "side")
_SHARPE = "CASE WHEN stddev_samp({0}) >= 1e-8 THEN avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(12) END"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return report.ledger(book(spark, folder), market(spark, folder), keys=SIDE)


_BUCKETS = f"""ranked AS (SELECT eom, permno, ret_exc_lead1m AS ret, CAST(floor(({rank_sql('ret_12_1')}) * 5 / (count(ret_12_1) OVER (PARTITION BY eom) + 1)) AS INTEGER) AS bucket FROM panel),
means AS (SELECT eom, avg(ret) FILTER (bucket = 4) - avg(ret) FILTER (bucket = 0) AS ls, avg(ret) FILTER (bucket = 4) AS top, avg(ret) FILTER (bucket = 0) AS bottom FROM ranked WHERE bucket IS NOT NULL GROUP BY eom HAVING avg(ret) FILTER (bucket = 4) IS NOT NULL AND avg(ret) FILTER (bucket = 0) IS NOT NULL),
w AS (SELECT *, product(1 + ls) OVER (ORDER BY eom ROWS UNBOUNDED PRECEDING) AS wealth FROM means)"""


@query(with_(_BUCKETS + f" SELECT {ds('eom')} AS eom, {rs('top')} AS top, {rs('bottom')} AS bottom, {rs('ls')} AS ls, {rs('wealth')} AS wealth, {rs('wealth / greatest(max(wealth) OVER (ORDER BY eom ROWS UNBOUNDED PRECEDING), 1) - 1')} AS drawdown FROM w", "panel"))
def decile_long_short(spark: SparkSession, folder: str) -> DataFrame:
    """Quintiles of past return, next month's mean of the outer two, their difference compounded, with drawdown."""
    rows = panel(spark, folder, "ret_12_1", "ret_exc_lead1m").withColumn("bucket", cross.bucket("ret_12_1", ["eom"], 5))
    means = rows.where("bucket in (0, 4)").groupBy("eom").agg(F.avg(F.when(F.col("bucket") == 4, F.col("ret_exc_lead1m"))).alias("top"), F.avg(F.when(F.col("bucket") == 0, F.col("ret_exc_lead1m"))).alias("bottom"))
    means = means.where("top is not null and bottom is not null").withColumn("ls", F.col("top") - F.col("bottom"))
    return series.with_drawdown(means, "ls", []).select(day("eom").alias("eom"), *[r(c).alias(c) for c in ("top", "bottom", "ls", "wealth", "drawdown")])


_LEDGER = ("long_ret", "short_ret", "ls_ret", "gross", "net", "beta_exante", "missing_ret_weight", "turnover", "cost", "total_ret", "bench_ret", "active_ret", "total_ret_net", "active_ret_net")


@query(with_(f"SELECT {ds('month')} AS month, n_long, n_short, first_month, {', '.join(f'{rs(c)} AS {c}' for c in _LEDGER)} FROM ledger", "ledger"))
def month_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).select(day("month").alias("month"), "n_long", "n_short", "first_month", *[r(c).alias(c) for c in _LEDGER])


_PERFORMANCE = """series AS ({s}),
wealth AS (SELECT *, product(1 + x) OVER (PARTITION BY series ORDER BY month ROWS UNBOUNDED PRECEDING) AS w FROM series),
down AS (SELECT *, w / greatest(1, max(w) OVER (PARTITION BY series ORDER BY month ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM wealth)"""
_SERIES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS series, '{basis}' AS cost_basis, {str(leg).lower()} AS leg, month, rf_m, sp500_ret, {x} AS x, CAST({a or 'NULL'} AS DOUBLE) AS a FROM ledger" for k, (x, a, basis, leg) in report.SERIES.items())


def _whole(sql: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT leg THEN {rs(sql, digits)} END"


@query(with_(_PERFORMANCE.format(s=_SERIES_SQL) + f""" SELECT series, cost_basis, count(*) AS n, {rs('avg(x)')} AS avg_monthly, {rs('avg(x) * 12')} AS ann_arith, {_whole('pow(product(1 + x), 12.0 / count(*)) - 1', 5)} AS cagr, {rs('product(1 + x) - 1', 4)} AS cumulative,
  {_whole(_SHARPE.format('(x - rf_m)'), 5)} AS sharpe, {_whole('min(dd)')} AS max_dd, {_whole(_SHARPE.format('a'), 5)} AS ir, {_whole('avg(CASE WHEN a > 0 THEN 1.0 WHEN a IS NOT NULL THEN 0.0 END)')} AS hit_rate,
  CASE WHEN NOT leg THEN strftime(arg_min(month, (-x, month)), '%Y-%m-%d') END AS best_month, {_whole('max(x)')} AS best_val, CASE WHEN NOT leg THEN strftime(arg_min(month, (x, month)), '%Y-%m-%d') END AS worst_month, {_whole('min(x)')} AS worst_val,
  {_whole('covar_pop(x, sp500_ret) / nullif(stddev_pop(x) * stddev_pop(sp500_ret), 0)')} AS corr_sp500 FROM down GROUP BY series, cost_basis, leg""", "ledger"))
def performance_table(spark: SparkSession, folder: str) -> DataFrame:
    """Strategy before and after cost, benchmark, index and both legs."""
    out = report.performance(ledger(spark, folder))
    digits = {"cumulative": 4, "cagr": 5, "sharpe": 5, "ir": 5}
    kept = {"series", "cost_basis", "n"}
    return out.select(*[F.col(c) if c in kept else day(c).alias(c) if c.endswith("_month") else r(c, digits.get(c, 6)).alias(c) for c in out.columns])


_GROWN = {"strategy_gross": "total_ret", "strategy_net": "total_ret_net", "benchmark": "bench_ret", "sp500": "sp500_ret"}


@query(with_(f"SELECT CASE WHEN year(month) = 2026 THEN '2026 YTD (Jan–Aug)' ELSE CAST(year(month) AS VARCHAR) END AS year, count(*) AS n, {', '.join(f'{rs(f"product(1 + {c}) - 1", 5)} AS {k}' for k, c in _GROWN.items())} FROM ledger GROUP BY year(month)", "ledger"))
def calendar_years(spark: SparkSession, folder: str) -> DataFrame:
    """Compounded returns by calendar year; the last year ends in August."""
    label = F.when(F.year("month") == 2026, "2026 YTD (Jan–Aug)").otherwise(F.year("month").cast("string"))
    return ledger(spark, folder).groupBy(label.alias("year")).agg(F.count(F.lit(1)).alias("n"), *[r(F.product(F.col(c) + 1) - 1, 5).alias(k) for k, c in _GROWN.items()])


#: The named date ranges of the report.
REGIMES = (("2021", "2021-01-01", "2021-12-31"), ("2022", "2022-01-01", "2022-12-31"), ("2023-2025", "2023-01-01", "2025-12-31"), ("2026", "2026-01-01", "2026-12-31"))


@query(with_("regimes(regime, first_day, last_day_) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in REGIMES) + f""")
SELECT regime, count(*) AS n, {rs('avg(active_ret) * 12')} AS active, {rs('avg(long_ret) * 12')} AS long_leg, {rs('avg(short_ret) * 12')} AS short_leg, {rs(_SHARPE.format('active_ret'), 5)} AS information_ratio
FROM ledger JOIN regimes ON month BETWEEN first_day AND last_day_ GROUP BY regime""", "ledger"))
def regime_table(spark: SparkSession, folder: str) -> DataFrame:
    """Annualised returns in named date ranges, by a range join with four rows; empty ranges have no row."""
    ranges = spark.createDataFrame([(a, b, c) for a, b, c in REGIMES], "regime string, a string, b string").select("regime", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    rows = ledger(spark, folder).join(F.broadcast(ranges), F.col("month").between(F.col("a"), F.col("b")))
    return rows.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), r(F.avg("active_ret") * 12).alias("active"), r(F.avg("long_ret") * 12).alias("long_leg"), r(F.avg("short_ret") * 12).alias("short_leg"), r(stats.ratio(F.avg("active_ret"), F.stddev_samp("active_ret")), 5).alias("information_ratio"))


_NW = """o AS (SELECT {g} month, x, y, covar_pop(y, x) OVER p / nullif(var_pop(x) OVER p, 0) AS b, avg(x) OVER p AS mx, avg(y) OVER p AS my FROM src WINDOW p AS (PARTITION BY {gp})),
e AS (SELECT *, my - b * mx AS a, y - (my - b * mx) - b * x AS e FROM o), v AS (SELECT *, e AS u, e * x AS v FROM e),
l AS (SELECT *, lag(u, 1) OVER t AS u1, lag(u, 2) OVER t AS u2, lag(u, 3) OVER t AS u3, lag(v, 1) OVER t AS v1, lag(v, 2) OVER t AS v2, lag(v, 3) OVER t AS v3 FROM v WINDOW t AS (PARTITION BY {gp} ORDER BY month)),
s AS (SELECT {g} count(*) AS n, any_value(a) AS alpha, any_value(b) AS beta, sum(x) AS sx, sum(x * x) AS sxx, sum(e * e) AS see,
  sum(u * u) + 1.5 * coalesce(sum(u * u1), 0) + 1.0 * coalesce(sum(u * u2), 0) + 0.5 * coalesce(sum(u * u3), 0) AS uu,
  sum(u * v) + 0.75 * coalesce(sum(u * v1 + v * u1), 0) + 0.5 * coalesce(sum(u * v2 + v * u2), 0) + 0.25 * coalesce(sum(u * v3 + v * u3), 0) AS uv,
  sum(v * v) + 1.5 * coalesce(sum(v * v1), 0) + 1.0 * coalesce(sum(v * v2), 0) + 0.5 * coalesce(sum(v * v3), 0) AS vv FROM l GROUP BY {gg}),
i AS (SELECT *, sxx / nullif(n * sxx - sx * sx, 0) AS i00, -sx / nullif(n * sxx - sx * sx, 0) AS i01, n / nullif(n * sxx - sx * sx, 0) AS i11, see / nullif(n - 2, 0) AS s2 FROM s)"""
_NW_OUT = f"n, {rs('alpha')} AS alpha, {rs('beta', 5)} AS beta, {rs('sqrt(s2 * i00)')} AS alpha_se, {rs('sqrt(s2 * i11)', 5)} AS beta_se, {rs('sqrt(i00 * i00 * uu + 2 * i00 * i01 * uv + i01 * i01 * vv)')} AS alpha_se_hac, {rs('sqrt(i01 * i01 * uu + 2 * i01 * i11 * uv + i11 * i11 * vv)', 5)} AS beta_se_hac"
_BETA_DIGITS = {"beta": 5, "beta_se": 5, "beta_se_hac": 5}


@query(with_("src AS (SELECT 'gross' AS kind, month, total_ret - rf_m AS y, sp500_exret AS x FROM ledger UNION ALL SELECT 'net', month, total_ret - rf_m - cost, sp500_exret FROM ledger), " + _NW.format(g="kind,", gp="kind", gg="kind") + f" SELECT kind, {_NW_OUT} FROM i", "ledger"))
def alpha_beta(spark: SparkSession, folder: str) -> DataFrame:
    """Regression on the market, gross and net, with ordinary and Newey-West errors of three lags."""
    rows = ledger(spark, folder).withColumn("gross_y", F.col("total_ret") - F.col("rf_m")).withColumn("net_y", F.col("total_ret") - F.col("rf_m") - F.col("cost"))
    long = rows.unpivot(["month", "sp500_exret"], ["gross_y", "net_y"], "kind", "y").withColumn("kind", F.regexp_replace("kind", "_y", ""))
    out = stats.newey_west(long, "sp500_exret", "y", "month", ["kind"])
    return out.select("kind", "n", *[r(c, _BETA_DIGITS.get(c, 6)).alias(c) for c in out.columns if c not in ("kind", "n")])


_BETAS = "src AS (SELECT kind, month, total_ret - rf_m AS y, sp500_exret AS x FROM (SELECT *, unnest(['beta_full_period', 'beta_' || year(month)]) AS kind FROM ledger)), " + _NW.format(g="kind,", gp="kind", gg="kind")


@query(with_(_BETAS + f""", hac AS (SELECT kind, n, beta, sqrt(i01 * i01 * uu + 2 * i01 * i11 * uv + i11 * i11 * vv) AS se FROM i)
SELECT kind AS metric, {rs('beta', 5)} AS value, {rs('se', 5)} AS se, {rs('beta / nullif(se, 0)', 4)} AS t_stat, n AS n_obs FROM hac WHERE kind = 'beta_full_period' OR n >= 3
UNION ALL SELECT unnest(['avg_ex_ante_beta', 'avg_net_exposure', 'min_net_exposure', 'max_net_exposure', 'corr_sp500']), unnest([{rs('avg(beta_exante)', 5)}, {rs('avg(net)', 5)}, {rs('min(net)', 5)}, {rs('max(net)', 5)}, {rs('covar_pop(total_ret, sp500_ret) / nullif(stddev_pop(total_ret) * stddev_pop(sp500_ret), 0)', 5)}]), NULL, NULL, count(*) FROM ledger""", "ledger"))
def neutrality_table(spark: SparkSession, folder: str) -> DataFrame:
    """Market beta of the whole period and by year, and the exposures beside it."""
    out = report.neutrality(ledger(spark, folder))
    return out.select("metric", r("value", 5).alias("value"), r("se", 5).alias("se"), r("t_stat", 4).alias("t_stat"), "n_obs")


@query(with_(f"""both_ AS (SELECT 'headline' AS run, l.* FROM ledger l UNION ALL SELECT 'sensitivity', l.* REPLACE (total_ret + x AS total_ret, active_ret + x AS active_ret, total_ret_net + x AS total_ret_net, active_ret_net + x AS active_ret_net)
  FROM ledger l JOIN (SELECT month, sum(CASE WHEN ret IS NULL THEN -0.3 * abs(weight) ELSE 0 END) AS x FROM book GROUP BY month) USING (month)),
src AS (SELECT run AS kind, month, total_ret - rf_m AS y, sp500_exret AS x FROM both_), {_NW.format(g="kind,", gp="kind", gg="kind")},
hac AS (SELECT kind, alpha, beta, sqrt(i00 * i00 * uu + 2 * i00 * i01 * uv + i01 * i01 * vv) AS ase, sqrt(i01 * i01 * uu + 2 * i01 * i11 * uv + i11 * i11 * vv) AS bse FROM i),
wealth AS (SELECT *, product(1 + total_ret) OVER (PARTITION BY run ORDER BY month ROWS UNBOUNDED PRECEDING) AS w FROM both_),
down AS (SELECT *, w / greatest(1, max(w) OVER (PARTITION BY run ORDER BY month ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM wealth),
m AS (SELECT run, {_SHARPE.format('active_ret')} AS ir, {_SHARPE.format('(total_ret - rf_m)')} AS sharpe, pow(product(1 + total_ret), 12.0 / count(*)) - 1 AS cagr, min(dd) AS max_dd, {_SHARPE.format('active_ret_net')} AS ir_net, avg(turnover) FILTER (NOT first_month) AS avg_turnover, avg(n_long) AS avg_n_long, avg(n_short) AS avg_n_short, avg(active_ret) * 12 AS ann_active FROM down GROUP BY run)
SELECT run, {rs('ir', 5)} AS ir, {rs('sharpe', 5)} AS sharpe, {rs('cagr', 5)} AS cagr, {rs('max_dd', 5)} AS max_dd, {rs('ir_net', 5)} AS ir_net, {rs('alpha * 12', 5)} AS alpha_ann, {rs('alpha / nullif(ase, 0)', 4)} AS alpha_t_nw, {rs('beta', 5)} AS beta, {rs('bse', 5)} AS beta_se_nw, {rs('beta / nullif(bse, 0)', 4)} AS beta_t_nw,
  {rs('avg_turnover', 5)} AS avg_turnover, {rs('avg_n_long', 5)} AS avg_n_long, {rs('avg_n_short', 5)} AS avg_n_short, {rs('ann_active', 5)} AS ann_active FROM m JOIN hac ON run = kind""", "ledger"))
def headline_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The headline figures, and the same with missing returns filled adversely."""
    b = book(spark, folder)
    filled = b.withColumn("ret", F.coalesce("ret", F.when(F.col("weight") > 0, -0.3).otherwise(0.3)))
    runs = b.withColumn("run", F.lit("headline")).unionByName(filled.withColumn("run", F.lit("sensitivity")))
    out = report.headline(report.ledger(runs, market(spark, folder), SIDE, ["run"]), ["run"])
    return out.select("run", *[r(c, 4 if "_t_" in c else 5).alias(c) for c in out.columns if c != "run"])


def _exposure_sql() -> str:
    moved = "FILTER (NOT first_month)"
    cells = {"avg_n_long": "avg(n_long)", "avg_n_short": "avg(n_short)", **{f"{c}_{k}": f"{k}({c})" for c in ("gross", "net", "filer_net") for k in ("avg", "min", "max")}, "top10_share_gross_avg": "avg(top10)", **{f"turnover_{k}": f"{k}(turnover) {moved}" for k in ("avg", "min", "max")}, "beta_exante_avg": "avg(beta_exante)", "missing_ret_weight_avg": "avg(missing_ret_weight)"}
    sizes = {"avg_abs_weight": "avg(abs(weight))", "max_abs_weight": "max(abs(weight))"}
    one = lambda cells, source: f"SELECT unnest([{', '.join(repr(k) for k in cells)}]) AS metric, unnest([{', '.join(rs(v, 5) for v in cells.values())}]) AS value FROM {source}"
    return one(cells, "m JOIN ledger USING (month)") + " UNION ALL " + one(sizes, "book")


@query(with_(f"""filed AS (SELECT DISTINCT permno, eom, 1 AS has_filing FROM filings),
k AS (SELECT b.*, has_filing, row_number() OVER (PARTITION BY month ORDER BY abs(weight) DESC, b.permno, weight) AS k FROM book b LEFT JOIN filed f ON b.permno = f.permno AND b.eom = f.eom),
m AS (SELECT month, sum(abs(weight)) FILTER (k <= 10) / sum(abs(weight)) AS top10, coalesce(sum(weight) FILTER (has_filing = 1), 0) AS filer_net FROM k GROUP BY month)
{_exposure_sql()}""", "ledger", "filings"))
def exposure_table(spark: SparkSession, folder: str) -> DataFrame:
    """Names, exposures, concentration and turnover of the book, one line each."""
    filed = filings(spark, folder).select("permno", "eom").distinct().withColumn("has_filing", F.lit(1))
    held = book(spark, folder).join(filed, ["permno", "eom"], "left")
    return report.exposures(ledger(spark, folder), held).select("metric", r("value", 5).alias("value"))


@query(with_(f"""c AS (SELECT permno, sum(weight) / (SELECT count(DISTINCT month) FROM book) AS w, arg_max(ticker, month) FILTER (trim(ticker) <> '') AS ticker FROM book GROUP BY permno)
SELECT * FROM (SELECT permno, {rs('w', 8)} AS average_weight, ticker, 'long' AS side FROM c ORDER BY w DESC, permno LIMIT 10) UNION ALL SELECT * FROM (SELECT permno, {rs('w', 8)}, ticker, 'short' FROM c ORDER BY w, permno LIMIT 10)""", "book"))
def top_holdings(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest mean weights of each side."""
    rows = book(spark, folder).withColumn("weight", F.col("weight").cast("decimal(10,4)"))
    return report.top_holdings(rows, labels=("ticker",)).select("permno", r(F.col("average_weight").cast("double"), 8).alias("average_weight"), "ticker", "side")


@query(with_(f"""q AS (SELECT eom, quantile_cont(me, 0.4) AS cut FROM panel GROUP BY eom), b AS (SELECT b.*, cut FROM book b JOIN q USING (eom) WHERE side = -1)
SELECT {ds('month')} AS month, count(*) AS n, {rs('sum(abs(weight) * ln(me)) / nullif(sum(CASE WHEN me IS NOT NULL THEN abs(weight) END), 0)')} AS log_me, {rs('sum(abs(weight) * dolvol_126d) / nullif(sum(CASE WHEN dolvol_126d IS NOT NULL THEN abs(weight) END), 0)', 4)} AS dolvol,
  {rs('sum(CASE WHEN me < cut THEN abs(weight) ELSE 0 END) / sum(abs(weight))')} AS below_cut FROM b GROUP BY month""", "book"))
def short_book(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted means over known values and the share below a monthly quantile, from a broadcast monthly lookup."""
    cut = panel(spark, folder, "me").groupBy("eom").agg(F.percentile("me", F.lit(0.4)).alias("cut"))
    b, w = book(spark, folder).where("side = -1").join(F.broadcast(cut), "eom"), F.abs("weight")  # one row per month
    b = b.withColumn("log_me", F.log("me"))
    return b.groupBy("month").agg(F.count(F.lit(1)).alias("n"), r(report.weighted_over_known("log_me", w)).alias("log_me"), r(report.weighted_over_known("dolvol_126d", w), 4).alias("dolvol"), r(F.sum(F.when(F.col("me") < F.col("cut"), w).otherwise(0.0)) / F.sum(w)).alias("below_cut")).withColumn("month", day("month"))


@query(with_(f"""c AS (SELECT permno, sum(weight * coalesce(ret, 0)) AS contribution, sum(weight) / (SELECT count(DISTINCT month) FROM book) AS average_weight, arg_max(ticker, month) FILTER (trim(ticker) <> '') AS ticker FROM book GROUP BY permno)
SELECT permno, {rs('contribution')} AS contribution, {rs('average_weight')} AS average_weight, upper(trim(ticker)) AS ticker FROM c""", "book"))
def contributors(spark: SparkSession, folder: str) -> DataFrame:
    """Contribution, mean weight over all months and last label by name."""
    c = report.contributions(book(spark, folder), labels=("ticker",))
    return c.select("permno", r("contribution").alias("contribution"), r("average_weight").alias("average_weight"), F.upper(F.trim("ticker")).alias("ticker"))


@query(with_("""c AS (SELECT permno, round(sum(weight * coalesce(ret, 0)) + 1e-9, 6) AS contribution FROM book GROUP BY permno)
SELECT * FROM (SELECT permno, contribution, 'top' AS kind FROM c ORDER BY contribution DESC, permno LIMIT 10) UNION ALL SELECT * FROM (SELECT permno, contribution, 'bottom' FROM c ORDER BY contribution, permno LIMIT 10)""", "book"))
def top_bottom_contributors(spark: SparkSession, folder: str) -> DataFrame:
    c = report.contributions(book(spark, folder), labels=()).select("permno", r("contribution").alias("contribution"))
    return c.orderBy(F.desc("contribution"), "permno").limit(10).withColumn("kind", F.lit("top")).unionByName(c.orderBy("contribution", "permno").limit(10).withColumn("kind", F.lit("bottom")))


_REPRICED = ("long_ret", "short_ret", "ls_ret", "total_ret", "active_ret", "total_ret_net", "active_ret_net")


@query(with_(f"""s AS (SELECT month, coalesce(sum(weight * -0.3) FILTER (weight > 0 AND ret IS NULL), 0) AS l, coalesce(sum(weight * 0.3) FILTER (weight < 0 AND ret IS NULL), 0) AS s FROM book GROUP BY month),
a AS (SELECT month, long_ret + l AS long_ret, short_ret + s AS short_ret, ls_ret + l + s AS ls_ret, total_ret + l + s AS total_ret, active_ret + l + s AS active_ret, total_ret_net + l + s AS total_ret_net, active_ret_net + l + s AS active_ret_net FROM ledger JOIN s USING (month))
SELECT {ds('month')} AS month, {', '.join(f'{rs(c)} AS {c}' for c in _REPRICED)} FROM a""", "ledger"))
def missing_return_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with missing returns filled adversely: -30 % for longs, +30 % for shorts."""
    filled = book(spark, folder).withColumn("ret", F.coalesce("ret", F.when(F.col("weight") > 0, -0.3).otherwise(0.3)))
    rows = report.ledger(filled, market(spark, folder), keys=SIDE)
    return rows.select(day("month").alias("month"), *[r(c).alias(c) for c in _REPRICED])


#: A bound that the largest weights of many months reach, so that rounding has to pass them by.
ROUND_CAP = 0.115


def _submitted(spark: SparkSession, folder: str) -> DataFrame:
    b = book(spark, folder).where("me is not null").withColumn("raw", F.col("side") * F.log1p("me"))
    leg = Window.partitionBy("month", "side")
    return report.round_legs(b.withColumn("weight", F.round(F.col("raw") / F.sum(F.abs("raw")).over(leg), 10)), cap=ROUND_CAP)


@query(with_(f"""x AS (SELECT *, round(side * ln(1 + me) / sum(ln(1 + me)) OVER (PARTITION BY month, side), 10) AS w FROM book WHERE me IS NOT NULL),
t AS (SELECT *, round(w, 6) AS v, side + sum(w) OVER (PARTITION BY month) / 2 AS target FROM x),
f AS (SELECT *, round(target - sum(v) OVER (PARTITION BY month, side), 6) AS rest FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY month, side ORDER BY CASE WHEN abs(v + rest) <= {ROUND_CAP} + 1e-9 THEN 0 ELSE 1 END, abs(v) DESC, permno) AS k FROM f),
u AS (SELECT *, CASE WHEN k = 1 AND abs(v + rest) <= {ROUND_CAP} + 1e-9 THEN v + rest ELSE v END AS rounded FROM o)
SELECT {ds('month')} AS month, permno, CAST(side AS INTEGER) AS side, round(rounded, 6) AS rounded, round(sum(rounded) OVER (PARTITION BY month, side), 6) AS leg_total FROM u""", "book"))
def rounded_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights rounded to six digits whose legs still sum to their targets, none moved beyond the bound by it."""
    rows = _submitted(spark, folder)
    return rows.select(day("month").alias("month"), "permno", F.col("side").cast("int").alias("side"), "rounded", F.round(F.sum("rounded").over(Window.partitionBy("month", "side")), 6).alias("leg_total"))


@query(with_(f"""x AS (SELECT permno, eom, ret_exc_lead1m AS y, {', '.join(CHARACTERISTICS)} FROM panel),
l AS (UNPIVOT x ON {', '.join(CHARACTERISTICS)} INTO NAME feature VALUE f),
k AS (SELECT feature, eom, {rank_sql('f', 'feature, eom')} AS a, {rank_sql('y', 'feature, eom')} AS b FROM l WHERE y IS NOT NULL),
i AS (SELECT feature, eom, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM k GROUP BY ALL)
SELECT feature, count(ic) AS months, {rs('avg(ic)', 5)} AS mean_ic, {rs('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)', 4)} AS t FROM i GROUP BY feature""", "panel"))
def ic_table(spark: SparkSession, folder: str) -> DataFrame:
    """Mean monthly rank correlation with the next return and its t-statistic, of all features at once in long form."""
    rows = panel(spark, folder, "ret_exc_lead1m", *CHARACTERISTICS)
    ic = stats.monthly_ic(cross.unpivot(rows, ["eom", "ret_exc_lead1m"], CHARACTERISTICS), "value", "ret_exc_lead1m", ["feature", "eom"])
    return ic.groupBy("feature").agg(F.count("ic").alias("months"), r(F.avg("ic"), 5).alias("mean_ic"), r(stats.t_stat("ic"), 4).alias("t"))


@query(with_(f"""x AS (SELECT eom, ret_exc_lead1m AS y, ({scaled_sql('ret_12_1')}) * 0.01 AS f FROM panel),
d AS (SELECT *, y - avg(y) OVER (PARTITION BY eom) AS yd, f - avg(f) OVER (PARTITION BY eom) AS fd FROM x WHERE y IS NOT NULL)
SELECT {rs('1 - sum(pow(y - f, 2)) / nullif(sum(y * y), 0)', 6)} AS r2, {rs('1 - sum(pow(yd - fd, 2)) / nullif(sum(yd * yd), 0)', 6)} AS r2_demeaned, count(*) AS n FROM d""", "panel"))
def forecast_r2(spark: SparkSession, folder: str) -> DataFrame:
    """Explained share of a scaled rank as forecast, raw and demeaned by month."""
    rows = panel(spark, folder, "ret_exc_lead1m", "ret_12_1").withColumn("f", cross.rank_scale("ret_12_1", ["eom"]) * 0.01).withColumnRenamed("ret_exc_lead1m", "y").where("y is not null")
    rows = rows.withColumns({"yd": cross.demean("y", ["eom"]), "fd": cross.demean("f", ["eom"])})
    return rows.agg(r(stats.oos_r2("f", "y")).alias("r2"), r(stats.oos_r2("fd", "yd")).alias("r2_demeaned"), F.count(F.lit(1)).alias("n"))


@query(with_(f"""x AS (SELECT size_grp, beta_60m AS x, ret AS y FROM panel WHERE beta_60m IS NOT NULL AND ret IS NOT NULL)
SELECT size_grp, count(*) AS n, {rs('regr_slope(y, x)')} AS slope, {rs('regr_intercept(y, x)')} AS intercept, {rs('(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0)) / nullif(count(*) - 2, 0)')} AS residual_variance, {rs('sum(x * y) / nullif(sum(x * x), 0)')} AS slope_origin FROM x GROUP BY size_grp""", "panel"))
def simple_ols(spark: SparkSession, folder: str) -> DataFrame:
    """Simple regressions by group, and slopes through the origin."""
    rows = panel(spark, folder, "size_grp", "beta_60m", "ret").where("beta_60m is not null and ret is not null")
    out = rows.groupBy("size_grp").agg(*stats.simple_ols("beta_60m", "ret"), (F.sum(F.col("beta_60m") * F.col("ret")) / F.nullif(F.sum(F.col("beta_60m") * F.col("beta_60m")), F.lit(0.0))).alias("slope_origin"))
    return out.select("size_grp", "n", *[r(c).alias(c) for c in ("slope", "intercept", "residual_variance", "slope_origin")])


@query(with_(f"""t AS (SELECT month, CASE WHEN missing_ret_weight > 0 THEN 'missing,cardinality' WHEN ls_ret < 0 THEN 'loss' ELSE 'cardinality' END AS relax FROM ledger),
s AS (SELECT array_to_string(list_filter(string_split(relax, ','), lambda x: x <> 'cardinality'), ',') AS token FROM t)
SELECT token, count(*) AS n FROM s WHERE token <> '' GROUP BY token""", "ledger"))
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies of comma lists after one token is dropped from them."""
    relax = F.when(F.col("missing_ret_weight") > 0, "missing,cardinality").when(F.col("ls_ret") < 0, "loss").otherwise("cardinality")
    token = F.array_join(F.filter(F.split(relax, ","), lambda x: x != "cardinality"), ",")
    return ledger(spark, folder).select(token.alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(with_(f"""SELECT CAST(width_bucket AS INTEGER) AS bin, count(*) AS n FROM (SELECT least(floor((ls_ret - lo) / nullif(hi - lo, 0) * 20) + 1, 20) AS width_bucket FROM ledger, (SELECT min(ls_ret) AS lo, max(ls_ret) AS hi FROM ledger)) GROUP BY ALL""", "ledger"))
def return_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty equal bins between the smallest and the largest monthly return."""
    w = Window.partitionBy()
    lo, hi = F.min("ls_ret").over(w), F.max("ls_ret").over(w)
    rows = ledger(spark, folder).withColumn("bin", F.least(F.floor((F.col("ls_ret") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 20) + 1, F.lit(20)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
