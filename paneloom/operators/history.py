"""Histories of changing attributes from periodic snapshots, by differencing consecutive snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """Of the rows with equal ``keys`` the one with the highest ``version``: ``keys``, ``version`` and ``columns``.
    Copies count once; different rows of the same highest version: the one with the largest ``columns``, compared from
    the left. A null version is lower than any. The best row of each map task is found before the shuffle."""
    best = F.max(F.struct(F.coalesce(F.col(version).cast("long"), F.lit(-(2**62))).alias("_v"), F.col(version).alias("_w"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, F.col("_best._w").alias(version), *[F.col(f"_best.c{i}").alias(c) for i, c in enumerate(columns)])


def fill_from_neighbours(df: DataFrame, entity: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Nulls of ``columns`` take the entity's last earlier known value, else its first later one."""
    before = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(entity).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in columns}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def snapshot_changes(snapshots: DataFrame, entity: str, period: str, attributes: Sequence[str], step: Column | None = None) -> DataFrame:
    """Differences of each snapshot against the one before: ``entity, at, seen, kind, <attributes>``.

    ``period`` dates the snapshots; ``step`` numbers them without gaps (the months of ``period`` by default). All pairs of
    neighbouring snapshots are compared in one null-safe full outer join on entity and number. ``kind`` is ``inserted``
    (no row in the snapshot before), ``changed`` (another value in some attribute, null being a value) or ``deleted`` (no
    row any more; also after the last snapshot). ``at`` is the period of the new row and null for deletions, ``seen`` that
    of the old row and null for insertions. One row per entity and snapshot is expected; null entities form one entity;
    rows with a null period belong to no snapshot and are left out. Attributes can't be named like the result's own columns.
    """
    if taken := {"step", "at", "seen", "kind"} & {a.lower() for a in (entity, *attributes)}:
        raise ValueError(f"reserved names: {sorted(taken)}")
    number = (F.year(period) * 12 + F.month(period)) if step is None else step
    rows = snapshots.where(F.col(period).isNotNull()).select(F.col(entity).alias("_e"), number.alias("_n"), F.col(period).alias("_p"), F.struct(*attributes).alias("_a"))
    new = rows.select(F.col("_e").alias("e1"), F.col("_n").alias("n1"), F.col("_p").alias("p1"), F.col("_a").alias("a1"))
    old = rows.select(F.col("_e").alias("e0"), (F.col("_n") + 1).alias("n0"), F.col("_p").alias("p0"), F.col("_a").alias("a0"))
    both = new.join(old, F.col("e1").eqNullSafe(F.col("e0")) & (F.col("n1") == F.col("n0")), "full_outer")
    kind = F.when(F.col("n0").isNull(), "inserted").when(F.col("n1").isNull(), "deleted").when(~F.col("a1").eqNullSafe(F.col("a0")), "changed")
    out = both.select(F.coalesce("e1", "e0").alias(entity), F.coalesce("n1", "n0").alias("step"), F.col("p1").alias("at"), F.col("p0").alias("seen"), kind.alias("kind"), F.coalesce("a1", "a0").alias("_a"))
    return out.where(F.col("kind").isNotNull()).select(entity, "step", "at", "seen", "kind", *[F.col(f"_a.{a}").alias(a) for a in attributes])


def version_history(changes: DataFrame, entity: str, attributes: Sequence[str]) -> DataFrame:
    """Versions from the events of :func:`snapshot_changes`: ``entity, valid_from, valid_to, <attributes>``, both ends the
    periods of the first and last row of the version. A snapshot without a row ends nothing: an insertion with the
    values of the deletion before it continues that version. A value that returns starts a new version.
    At most one row per entity and change is sorted here, not the snapshots themselves."""
    w = Window.partitionBy(entity).orderBy("step", F.when(F.col("kind") == "deleted", 0).otherwise(1))
    e = changes.withColumn("_a", F.struct(*attributes))
    e = e.withColumn("_before", F.lag("_a").over(w)).withColumn("_kind", F.lag("kind").over(w))
    same = (F.col("kind") == "inserted") & (F.col("_kind") == "deleted") & F.col("_a").eqNullSafe(F.col("_before"))
    # A version ends with the last row seen before the next start: in its own events or in the event that follows.
    e = e.withColumn("_start", (F.col("kind") != "deleted") & ~same)
    e = e.withColumn("_version", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("seen").over(w))
    last = F.max(F.greatest("at", "seen", "_next"))
    ends = e.groupBy(entity, "_version").agg(F.min("at").alias("valid_from"), last.alias("valid_to"), F.first(F.when(F.col("_start"), F.col("_a")), ignorenulls=True).alias("_a"))
    return ends.select(entity, "valid_from", "valid_to", *[F.col(f"_a.{a}").alias(a) for a in attributes])
