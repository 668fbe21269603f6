"""Time-series operators: along one entity's rows or one monthly series. Months are month-end dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from paneloom.functions.columns import month_number


def along(entity: Sequence[str], time: str = "eom") -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(time)


def next_month(day: Column | str, months: int = 1) -> Column:
    """The month end ``months`` after the month of ``day``."""
    return F.last_day(F.add_months(day, months))


def shift_exact(value: str, entity: Sequence[str], rows: int, months: int | None = None, time: str = "eom") -> Column:
    """``value`` ``rows`` rows before (negative: after), if that row lies exactly ``months`` months away; else null."""
    months = rows if months is None else months
    w = along(entity, time)
    return F.when(month_number(F.lag(time, rows).over(w)) == month_number(time) - months, F.lag(value, rows).over(w))


def trailing(aggregate: Column, entity: Sequence[str], rows: int, enough: Column, least: int, time: str = "eom") -> Column:
    """``aggregate`` over the last ``rows`` rows with the current one; null unless ``enough`` (a count) reaches ``least``."""
    w = along(entity, time).rowsBetween(1 - rows, 0)
    return F.when(enough.over(w) >= least, aggregate.over(w))


def trailing_compound(value: str, entity: Sequence[str], rows: int = 12, least: int = 6, time: str = "eom") -> Column:
    """Compounded return of the last ``rows`` rows."""
    return trailing(F.product(F.col(value) + 1), entity, rows, F.count(value), least, time) - 1


def trailing_std(value: str, entity: Sequence[str], rows: int = 12, least: int = 6, time: str = "eom") -> Column:
    return trailing(F.stddev_samp(value), entity, rows, F.count(value), least, time)


def rolling_beta(y: str, x: str, entity: Sequence[str], rows: int = 12, time: str = "eom") -> Column:
    """Slope of ``y`` on ``x`` over full windows of ``rows`` rows."""
    w = along(entity, time).rowsBetween(1 - rows, 0)
    return F.when(F.count(F.col(y) + F.col(x)).over(w) == rows, F.covar_samp(y, x).over(w) / F.nullif(F.var_samp(x).over(w), F.lit(0.0)))


def forward_beta(df: DataFrame, entity: str, y: str, x: str, months: int = 12, into: str = "forward_beta") -> DataFrame:
    """Slope of ``y`` on ``x`` over the next ``months`` months, null unless all are there without a gap."""
    w = along([entity]).rowsBetween(1, months)
    whole = (F.count(F.col(y) + F.col(x)).over(w) == months) & (F.max(month_number("eom")).over(w) == month_number("eom") + months)
    return df.withColumn(into, F.when(whole, F.covar_pop(y, x).over(w) / F.nullif(F.var_pop(x).over(w), F.lit(0.0))))


def past_mean(value: str, entity: Sequence[str], rows: int = 12, time: str = "eom") -> Column:
    """Mean of the ``rows`` rows before the current one; null on the first row."""
    return F.avg(value).over(along(entity, time).rowsBetween(-rows, -1))


def surprise(value: str, entity: Sequence[str], rows: int = 12, time: str = "eom") -> Column:
    """(count - baseline) / sqrt(baseline + 1) against the mean of the past rows (0 without a past)."""
    base = F.coalesce(past_mean(value, entity, rows, time), F.lit(0.0))
    return (F.col(value) - base) / F.sqrt(base + 1)


def densify_months(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """A row for each key and each month from the key table's first to its last month; absent values are 0."""
    first, last = df.agg(F.min(F.trunc(time, "month")), F.max(F.trunc(time, "month"))).first()
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    spine = df.select(*keys).distinct().withColumn(time, F.explode(months)).withColumn(time, F.last_day(time))
    return spine.join(df.select(*keys, time, value), [*keys, time], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def expanding_past_median(df: DataFrame, time: str, value: str, into: str) -> DataFrame:
    """For one row per period: the median of ``value`` over all earlier periods (null on the first). The monthly series is one
    short array that is sliced, since ordered frames do not take a median."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    past = F.sort_array(F.collect_list(value).over(w))
    n = F.size(past)
    middle = (F.get(past, F.floor((n - 1) / 2).cast("int")) + F.get(past, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(into, F.when(n > 0, middle))


def ema_gap_reset(df: DataFrame, entity: Sequence[str], value: str, alpha: float = 0.5, time: str = "eom", into: str = "smooth") -> DataFrame:
    """s = alpha z + (1 - alpha) s_before along consecutive months; a month without a row starts anew with s = z.

    With w = 1 - alpha and k counting months within a run of consecutive ones, s_k = w^k (z_0 + alpha sum z_j w^-j): a running
    sum, linear in the rows and compiled like any other window. Runs may have up to 300 / -log10(w) months (about a
    thousand for alpha 0.5); a larger ``alpha`` than 0.68 is refused, as w^-j would leave the range of doubles within 50 years.
    """
    if not 0 < alpha <= 0.68:
        raise ValueError("alpha must be in (0, 0.68]")
    w = along(entity, time)
    gap = F.coalesce(month_number(time) - month_number(F.lag(time).over(w)) != 1, F.lit(True)).cast("int")
    runs = df.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(*entity, "_run").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_k", F.count(F.lit(1)).over(upto) - 1)
    part = F.col(value).cast("double") * F.pow(F.lit(1 - alpha), -F.col("_k")) * F.when(F.col("_k") == 0, 1.0).otherwise(alpha)
    return runs.withColumn(into, F.sum(part).over(upto) * F.pow(F.lit(1 - alpha), F.col("_k"))).drop("_gap", "_run", "_k")


def wealth(value: str, entity: Sequence[str], time: str = "eom") -> Column:
    """Value of 1 invested before the first row."""
    return F.product(F.col(value) + 1).over(along(entity, time).rowsBetween(Window.unboundedPreceding, 0))


def with_drawdown(df: DataFrame, value: str, entity: Sequence[str], time: str = "eom") -> DataFrame:
    """``wealth`` and ``drawdown``, the loss from the highest wealth so far, which is at least the 1 of the start."""
    df = df.withColumn("wealth", wealth(value, entity, time))
    peak = F.greatest(F.max("wealth").over(along(entity, time).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return df.withColumn("drawdown", F.col("wealth") / peak - 1)


def with_log_drawdown(df: DataFrame, value: str, entity: Sequence[str], time: str = "eom") -> DataFrame:
    """``log_wealth`` and ``log_drawdown`` in log units, from the highest value so far without a floor."""
    w = along(entity, time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("log_wealth", F.sum(F.log(F.col(value) + 1)).over(w))
    return df.withColumn("log_drawdown", F.col("log_wealth") - F.max("log_wealth").over(w))


def retained(df: DataFrame, entity: str, time: str = "eom") -> DataFrame:
    """Rows whose entity has a row in the next month too, by an equi-join on the shifted month."""
    after = df.select(F.col(entity), F.last_day(F.add_months(time, -1)).alias(time)).distinct()
    return df.join(after, [entity, time], "left_semi")
