"""Cross-sectional operators: within one period (or any group). Nulls are missing values and never take part in a rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from paneloom.session import materialize


def by(*group: str) -> WindowSpec:
    return Window.partitionBy(*group)


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank from 1 among the non-null values of the group; equal values share the mean of their places: of the first, counted from
    below, and of the last, counted from above. One partitioning for both; a task holds a group, so for groups beyond a task use
    :func:`with_average_rank`."""
    w = by(*group)
    first = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    last = F.count(value).over(w) + 1 - F.rank().over(w.orderBy(F.col(value).desc_nulls_last()))
    return F.when(F.col(value).isNotNull(), (first + last) / F.lit(2.0))


def with_average_rank(df: DataFrame, value: str, group: Sequence[str], rank: str = "rank", count: str = "known") -> DataFrame:
    """``df`` with ``rank`` and the number ``count`` of known values of the group, as :func:`average_rank` gives them, for groups of
    any size: no task ever holds a group. Distinct values are counted (ties collapse before the shuffle), cut into value
    ranges over the whole cluster and numbered within each range; the ranges' totals, one row per group and range, give
    the offsets; the ranks are joined back by group and value."""
    keys = [F.col(c) for c in group]
    tied = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = materialize(tied.repartitionByRange(*keys, F.col(value)).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *group)
    before = F.sum("_c").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    totals = parts.groupBy(*group, "_part").agg(F.sum("_c").alias("_t"))
    earlier = F.sum("_t").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*group)).alias("_all"))
    same = lambda left, right: [F.col(c).eqNullSafe(F.col(f"{right}{i}")) for i, c in enumerate(left)]
    on = (F.col("_part") == F.col("_p"))
    for x in same(group, "_g"):
        on = on & x
    placed = parts.withColumn("_inside", F.coalesce(before, F.lit(0))).join(totals, on)
    placed = placed.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(group)], F.col(value).alias("_v"), (F.col("_before") + F.col("_inside") + (F.col("_c") + 1) / F.lit(2.0)).alias(rank), F.col("_all").alias(count))
    back = F.col(value) == F.col("_v")
    for x in same(group, "_h"):
        back = back & x
    return df.join(placed.hint("merge"), back, "left").select(*df.columns, rank, count)


def known_count(value: str, group: Sequence[str]) -> Column:
    return F.count(value).over(by(*group))


def rank_scale(value: str, group: Sequence[str]) -> Column:
    """Average rank mapped to [-1, 1]; null, and groups with at most one value, give 0."""
    n = known_count(value, group)
    scaled = (average_rank(value, group) - 1) * F.lit(2.0) / F.nullif(n - 1, F.lit(0)) - 1
    return F.coalesce(F.when(n > 1, scaled), F.lit(0.0))


def percent_rank(value: str, group: Sequence[str], missing: float = 0.5) -> Column:
    """Average rank over the number of values; null gives ``missing``."""
    return F.coalesce(average_rank(value, group) / F.nullif(known_count(value, group), F.lit(0)), F.lit(missing))


def dense_rank_scale(df: DataFrame, value: str, group: Sequence[str], into: str) -> DataFrame:
    """Nulls become the group's median, dense ranks from 0 are divided by their maximum and mapped to [-1, 1]; a group of one
    distinct value gives 0, as does one without values."""
    filled = df.withColumn(into, F.coalesce(value, F.median(value).over(by(*group))))
    place = F.dense_rank().over(by(*group).orderBy(into)) - 1
    filled = filled.withColumn("_place", place)
    top = F.max("_place").over(by(*group))
    return filled.withColumn(into, F.when(F.col(into).isNull() | (top == 0), F.lit(0.0)).otherwise(F.col("_place") * F.lit(2.0) / top - 1)).drop("_place")


def bucket(value: str, group: Sequence[str], buckets: int = 10) -> Column:
    """floor(rank * buckets / (n + 1)): 0 to ``buckets`` - 1; null for null."""
    return F.floor(average_rank(value, group) * buckets / (known_count(value, group) + 1)).cast("int")


def zscore(value: str, group: Sequence[str], population: bool = False) -> Column:
    """Distance from the group's mean in (sample or population) standard deviations; 0 for null and for groups that do not vary."""
    w = by(*group)
    sd = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return F.coalesce(F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))), F.lit(0.0))


def demean(value: str, group: Sequence[str]) -> Column:
    return F.col(value) - F.avg(value).over(by(*group))


def clip(value: Column | str, low: Column | float, high: Column | float) -> Column:
    """``value`` moved into [low, high]; null stays null."""
    c = F.col(value) if isinstance(value, str) else value
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def winsorize(value: str, group: Sequence[str], tail: float = 0.01) -> Column:
    """Clipped at the group's ``tail`` and 1 - ``tail`` quantiles (linear interpolation)."""
    w = by(*group)
    return clip(value, F.percentile(value, F.lit(tail)).over(w), F.percentile(value, F.lit(1 - tail)).over(w))


def above_group_quantile(value: str, group: Sequence[str], q: float) -> Column:
    """Whether ``value`` is at least the group's ``q`` quantile; null gives false."""
    return F.coalesce(F.col(value) >= F.percentile(value, F.lit(q)).over(by(*group)), F.lit(False))


def missing_flags(df: DataFrame, columns: Sequence[str], reference: Column, rate: float = 0.2) -> tuple[DataFrame, list[str]]:
    """``df`` with a flag ``miss_<c>`` for each column whose share of nulls among the ``reference`` rows exceeds ``rate``; the
    flag marks the nulls of all rows. One aggregate over the reference rows decides which flags there are."""
    share = df.where(reference).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    chosen = [c for c in columns if share[c] is not None and share[c] > rate]
    return df.withColumns({f"miss_{c}": F.col(c).isNull().cast("int") for c in chosen}), chosen


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form of ``columns``. Ranking hundreds of features costs two window specifications in this form, not two each."""
    return df.unpivot(list(keys), list(columns), name, value)


def rank_scale_many(df: DataFrame, keys: Sequence[str], group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """:func:`rank_scale` of many columns at once, in long form: ``keys, feature, value`` with the scaled rank as value."""
    long = unpivot(df, list(dict.fromkeys([*keys, *group])), columns)
    return long.withColumn("value", rank_scale("value", [*group, "feature"]))


def top_bottom(df: DataFrame, value: str, group: Sequence[str], n: int, tie: str) -> DataFrame:
    """The ``n`` largest (side 1) and ``n`` smallest (side -1) of each group, nulls left out, ties by ``tie``; in groups of
    fewer than 2n rows a row may be on both sides."""
    w = by(*group)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_up": F.row_number().over(w.orderBy(F.desc(value), tie)), "_down": F.row_number().over(w.orderBy(value, tie))})
    sides = F.array(F.when(F.col("_up") <= n, F.lit(1)), F.when(F.col("_down") <= n, F.lit(-1)))
    return ranked.withColumn("side", F.explode(F.array_compact(sides))).drop("_up", "_down")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
