"""Monthly ledgers of weighted books and their report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.series import next_month, with_drawdown
from paneloom.operators.stats import newey_west, ratio, safe_corr


#: The yearly hurdle over the cash rate, the cost of trading in basis points and the gross exposure that turnover refers to.
HURDLE, COST_BPS, GROSS = 0.04, 10.0, 2.0


def turnover(book: DataFrame, keys: Sequence[str] = ("permno",), by: Sequence[str] = ()) -> DataFrame:
    """``by, month, moved``: the sum of absolute weight changes against the month before, by a full outer join of the two books; a name
    that is in one only counts with its whole weight."""
    now = book.select(*by, "month", *keys, F.col("weight").alias("w1"))
    before = book.select(*by, next_month("month").alias("month"), *keys, F.col("weight").alias("w0"))
    both = now.join(before, [*by, "month", *keys], "full_outer")
    return both.groupBy(*by, "month").agg(F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("moved"))


def ledger(book: DataFrame, market: DataFrame, keys: Sequence[str] = ("permno",), by: Sequence[str] = (), cost_bps: float = COST_BPS, hurdle: float = HURDLE) -> DataFrame:
    """One accounting row per month of ``book`` (``month, weight, ret, beta_60m`` and ``keys``), for each of ``by`` if there are several.

    Missing returns and unknown betas count as zero; returns of a leg and the net exposure have twelve digits, so that the order of summation decides
    nothing (legs that hold the same cancel exactly). The book earns the cash rate, its legs' excess returns and, on its net
    exposure, what the other cash rate that the returns are in excess of is above it (nothing where that rate is unknown).
    The benchmark is the cash rate with a twelfth of the yearly hurdle; ``active_ret`` is against it. Turnover is one-way and of a gross exposure
    of 2; in the ``first_month`` the whole book counts as bought.
    """
    w, x = F.col("weight"), F.col("weight") * F.coalesce("ret", F.lit(0.0))
    by_month = book.groupBy(*by, "month").agg(
        F.round(F.sum(F.when(w > 0, x).otherwise(0.0)), 12).alias("long_ret"), F.round(F.sum(F.when(w < 0, x).otherwise(0.0)), 12).alias("short_ret"), F.count(F.when(w > 0, 1)).alias("n_long"), F.count(F.when(w < 0, 1)).alias("n_short"),
        F.sum(F.abs(w)).alias("gross"), F.round(F.sum(w), 12).alias("net"), F.sum(w * F.coalesce("beta_60m", F.lit(0.0))).alias("beta_exante"), F.sum(F.when(F.col("ret").isNull(), F.abs(w)).otherwise(0.0)).alias("missing_ret_weight"),
    )
    rates = F.broadcast(market.select("month", "rf_m", "rf_pipe", "sp500_ret", "sp500_exret"))  # one row per month
    out = by_month.join(turnover(book, keys, by), [*by, "month"]).join(rates, "month").withColumn("ls_ret", F.col("long_ret") + F.col("short_ret"))
    cash = F.coalesce(F.col("net") * (F.col("rf_pipe") - F.col("rf_m")), F.lit(0.0))
    out = out.withColumns({"turnover": F.col("moved") / 2 / GROSS, "cost": F.lit(cost_bps / 1e4) * F.col("moved"), "total_ret": F.col("rf_m") + F.col("ls_ret") + cash, "bench_ret": F.col("rf_m") + hurdle / 12})
    out = out.withColumn("active_ret", F.col("total_ret") - F.col("bench_ret"))
    return out.withColumns({"total_ret_net": F.col("total_ret") - F.col("cost"), "active_ret_net": F.col("active_ret") - F.col("cost"), "first_month": F.col("month") == F.min("month").over(Window.partitionBy(*by))})


#: Series of a ledger: returns, active returns (or none), whether cost is taken off, whether it is a leg's contribution only.
SERIES = {
    "strategy_gross": ("total_ret", "active_ret", "gross", False), "strategy_net": ("total_ret_net", "active_ret_net", "net", False), "benchmark": ("bench_ret", None, "gross", False),
    "sp500": ("sp500_ret", "sp500_ret - bench_ret", "gross", False), "long_leg_excess_contrib": ("long_ret", None, "gross", True), "short_leg_excess_contrib": ("short_ret", None, "gross", True),
}


def performance(rows: DataFrame, by: Sequence[str] = (), series: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """One row per series of a :func:`ledger` (and each of ``by``): mean, annual mean, compound growth, Sharpe ratio, deepest drawdown from
    a start of 1, information ratio, hit rate, best and worst month (of equals the first), correlation with the index. Legs have mean, annual mean and
    compounded sum only; ratios of a series that does not vary are null."""
    each = [F.struct(F.lit(k).alias("series"), F.expr(SERIES[k][0]).alias("x"), (F.expr(SERIES[k][1]) if SERIES[k][1] else F.lit(None)).cast("double").alias("a"), F.lit(SERIES[k][2]).alias("cost_basis"), F.lit(SERIES[k][3]).alias("leg")) for k in series]
    long = rows.select(*by, "month", "rf_m", "sp500_ret", F.explode(F.array(*each)).alias("_s")).select(*by, "month", "rf_m", "sp500_ret", "_s.*").where("x is not null")
    long = with_drawdown(long, "x", [*by, "series"], "month")
    x, a, excess, day = F.col("x"), F.col("a"), F.col("x") - F.col("rf_m"), F.unix_date("month")
    grown = F.product(x + 1)
    out = long.groupBy(*by, "series", "cost_basis", "leg").agg(
        F.count(x).alias("n"), F.avg(x).alias("avg_monthly"), (F.avg(x) * 12).alias("ann_arith"), (F.pow(grown, F.lit(12.0) / F.count(x)) - 1).alias("cagr"), (grown - 1).alias("cumulative"),
        ratio(F.avg(excess), F.stddev_samp(excess)).alias("sharpe"), F.min("drawdown").alias("max_dd"), ratio(F.avg(a), F.stddev_samp(a)).alias("ir"), F.avg((a > 0).cast("int")).alias("hit_rate"),
        F.max(F.struct("x", (-day).alias("d"))).alias("_best"), F.min(F.struct("x", day.alias("d"))).alias("_worst"), safe_corr("x", "sp500_ret").alias("corr_sp500"),
    )
    out = out.withColumns({"best_month": F.date_from_unix_date(-F.col("_best.d")), "best_val": F.col("_best.x"), "worst_month": F.date_from_unix_date(F.col("_worst.d")), "worst_val": F.col("_worst.x")}).drop("_best", "_worst")
    whole = ("cagr", "sharpe", "max_dd", "ir", "hit_rate", "best_month", "best_val", "worst_month", "worst_val", "corr_sp500")
    return out.withColumns({c: F.when(~F.col("leg"), F.col(c)) for c in whole}).drop("leg")


def headline(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The figures that a run is judged by, one row per ``by``: ratios, growth, drawdown, regression on the market with
    autocorrelation-robust errors, turnover without the first month, names."""
    gross = performance(rows, by, ["strategy_gross"]).select(*by, "ir", "sharpe", "cagr", "max_dd")
    net = performance(rows, by, ["strategy_net"]).select(*by, F.col("ir").alias("ir_net"))
    line = newey_west(rows.withColumn("_y", F.col("total_ret") - F.col("rf_m")), "sp500_exret", "_y", "month", by)
    line = line.select(*by, (F.col("alpha") * 12).alias("alpha_ann"), (F.col("alpha") / F.nullif(F.col("alpha_se_hac"), F.lit(0.0))).alias("alpha_t_nw"), "beta", F.col("beta_se_hac").alias("beta_se_nw"), (F.col("beta") / F.nullif(F.col("beta_se_hac"), F.lit(0.0))).alias("beta_t_nw"))
    means = rows.groupBy(*by).agg(F.avg(F.when(~F.col("first_month"), F.col("turnover"))).alias("avg_turnover"), F.avg("n_long").alias("avg_n_long"), F.avg("n_short").alias("avg_n_short"), (F.avg("active_ret") * 12).alias("ann_active"))
    join = lambda a, b: a.join(b, list(by)) if by else a.join(b.hint("broadcast"))  # noqa: E731  (without groups each side is a single row)
    return join(join(join(gross, net), line), means)


def exposures(rows: DataFrame, book: DataFrame) -> DataFrame:
    """``metric, value``: names, gross, net and filers' net exposure, concentration, turnover without the first month, ex-ante beta and
    missing returns of a ledger and its book (with ``has_filing``)."""
    w = F.abs("weight")
    ranked = book.withColumn("_k", F.row_number().over(Window.partitionBy("month").orderBy(F.desc(w), "permno", "weight")))
    months = ranked.groupBy("month").agg((F.sum(F.when(F.col("_k") <= 10, w)) / F.nullif(F.sum(w), F.lit(0.0))).alias("top10"), F.sum(F.when(F.col("has_filing") == 1, F.col("weight")).otherwise(0.0)).alias("filer_net"))
    sizes = book.agg(F.avg(w).alias("avg_abs_weight"), F.max(w).alias("max_abs_weight"))
    moved = F.when(~F.col("first_month"), F.col("turnover"))
    spread = lambda c, name: [f(c).alias(f"{name}_{k}") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    one = rows.join(months, "month").agg(F.avg("n_long").alias("avg_n_long"), F.avg("n_short").alias("avg_n_short"), *spread("gross", "gross"), *spread("net", "net"), *spread("filer_net", "filer_net"), F.avg("top10").alias("top10_share_gross_avg"), *spread(moved, "turnover"), F.avg("beta_exante").alias("beta_exante_avg"), F.avg("missing_ret_weight").alias("missing_ret_weight_avg"))
    made = [d.unpivot([], d.columns, "metric", "value") for d in (one, sizes)]
    return made[0].unionByName(made[1])


def neutrality(rows: DataFrame, least: int = 3) -> DataFrame:
    """``metric, value, se, t_stat, n_obs``: the market beta of the whole period and of each year of at least ``least`` months, with robust errors;
    then mean ex-ante beta, net exposure and correlation with the index, without errors."""
    y = rows.select("month", (F.col("total_ret") - F.col("rf_m")).alias("y"), "sp500_exret", F.explode(F.array(F.lit("beta_full_period"), F.concat(F.lit("beta_"), F.year("month")))).alias("metric"))
    line = newey_west(y, "sp500_exret", "y", "month", ["metric"]).where((F.col("metric") == "beta_full_period") | (F.col("n") >= least))
    betas = line.select("metric", F.col("beta").alias("value"), F.col("beta_se_hac").alias("se"), (F.col("beta") / F.nullif(F.col("beta_se_hac"), F.lit(0.0))).alias("t_stat"), F.col("n").alias("n_obs"))
    one = rows.agg(F.avg("beta_exante").alias("avg_ex_ante_beta"), F.avg("net").alias("avg_net_exposure"), F.min("net").alias("min_net_exposure"), F.max("net").alias("max_net_exposure"), safe_corr("total_ret", "sp500_ret").alias("corr_sp500"), F.count(F.lit(1)).alias("n_obs"))
    more = one.unpivot(["n_obs"], [c for c in one.columns if c != "n_obs"], "metric", "value")
    none = F.lit(None).cast("double")
    return betas.unionByName(more.select("metric", "value", none.alias("se"), none.alias("t_stat"), "n_obs"))


def weighted_over_known(value: str, weight: Column) -> Column:
    """Mean of the known values by weight; the weights of unknown ones do not count."""
    return F.sum(weight * F.col(value)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), weight)), F.lit(0.0))


def contributions(book: DataFrame, entity: str = "permno", labels: Sequence[str] = ("ticker", "company_name")) -> DataFrame:
    """Summed weight times return (null as 0), mean weight over all months of the book, and the last known labels by name."""
    months = book.select("month").distinct().count()
    latest = [F.max_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", F.col("month"))).alias(c) for c in labels]
    by = book.groupBy(entity).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("contribution"), F.sum("weight").alias("_w"), *latest)
    return by.withColumn("average_weight", F.col("_w") / F.nullif(F.lit(months), F.lit(0))).drop("_w")


def top_holdings(book: DataFrame, n: int = 10, labels: Sequence[str] = ("ticker", "company_name")) -> DataFrame:
    """The ``n`` names of largest and of smallest mean weight over all months (ties by name), with their last labels and their ``side``."""
    c = contributions(book, labels=labels).drop("contribution")
    top = c.orderBy(F.desc("average_weight"), "permno").limit(n).withColumn("side", F.lit("long"))
    return top.unionByName(c.orderBy("average_weight", "permno").limit(n).withColumn("side", F.lit("short")))


def round_legs(book: DataFrame, digits: int = 6, cap: float | None = None) -> DataFrame:
    """``rounded``: weights to ``digits`` so that each leg of a month still sums to its target: half the gross exposure of 2 and half the
    month's net, 1 + n / 2 long and -(1 - n / 2) short. What rounding leaves over goes to the largest weight of the leg (ties by name) that can
    take it without passing ``cap``; without such a name the leg stays as rounded."""
    leg = Window.partitionBy("month", F.signum("weight"))
    b = book.withColumn("_r", F.round("weight", digits)).withColumn("_net", F.sum("weight").over(Window.partitionBy("month")))
    target = F.when(F.col("weight") > 0, 1 + F.col("_net") / 2).when(F.col("weight") < 0, F.col("_net") / 2 - 1)
    b = b.withColumn("_rest", F.round(target - F.sum("_r").over(leg), digits))
    room = F.abs(F.col("_r") + F.col("_rest")) <= F.lit(cap + 1e-9) if cap is not None else F.lit(True)
    b = b.withColumn("_n", F.row_number().over(leg.orderBy(F.when(room, 0).otherwise(1), F.desc(F.abs("_r")), "permno")))
    takes = room & (F.col("_n") == 1) & (F.col("weight") != 0)
    return b.withColumn("rounded", F.round(F.when(takes, F.col("_r") + F.col("_rest")).otherwise(F.col("_r")), digits)).drop("_r", "_net", "_rest", "_n")
