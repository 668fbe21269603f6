"""Choosing among signals and features with past data only, and guards against leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that hold the future and can never be features.
FORBIDDEN = frozenset({"stock_exret", "target_month", "ret_exc_lead1m", "forward_beta"})


def guard(features: Sequence[str], needed: Sequence[str] = ()) -> list[str]:
    """``features``, if none of them holds the future and all ``needed`` ones are among them; else ValueError."""
    if bad := FORBIDDEN & set(features):
        raise ValueError(f"features hold the future: {sorted(bad)}")
    if gone := set(needed) - set(features):
        raise ValueError(f"features are missing: {sorted(gone)}")
    return list(features)


def best_by_validation(ic: DataFrame, years: Sequence[int], name: str = "feature", month: str = "month") -> DataFrame:
    """``test_year, <name>, mean_ic``: for each year the candidate of the highest mean ``ic`` over the 24 months before it (ties: the
    first name; means are compared to ten digits, so that the order of summation does not decide). Months of the year itself never
    count."""
    rows = ic.withColumn("test_year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    rows = rows.where((F.year(month) >= F.col("test_year") - 2) & (F.year(month) < F.col("test_year")) & F.col("ic").isNotNull())
    means = rows.groupBy("test_year", name).agg(F.avg("ic").alias("mean_ic"))
    w = Window.partitionBy("test_year").orderBy(F.desc(F.round("mean_ic", 10)), name)
    return means.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_up(scores: DataFrame, group: str, score: str, least: int, name: str = "feature", chosen: str = "selected") -> DataFrame:
    """The chosen rows and, in each group with fewer than ``least`` of them, the next ones by absolute ``score`` (nulls last, ties by name)."""
    w = Window.partitionBy(group).orderBy(F.desc(F.col(chosen)), F.round(F.abs(score), 10).desc_nulls_last(), name)
    return scores.withColumn("_n", F.row_number().over(w)).where(F.col(chosen) | (F.col("_n") <= least)).drop("_n")
