"""Attributes as known at event time, by a tagged union that is sorted and carried forward.

Events and attribute changes are put into one stream, sorted by entity and time with changes before events of the same
time, and the best change so far is carried forward. The stream is cut by entity *and* time bucket, so that one hot
entity is spread over all its buckets. What an entity knew when a bucket began is the best change of its earlier buckets: one
row per entity and bucket that has rows, made from the same shuffled stream (Spark reuses the exchange, so each input
is read once) and joined back to it without moving it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import month_number


def known_at(
    events: DataFrame, changes: DataFrame, *, event_entity: str, event_time: str, keep: Sequence[str], change_entity: str,
    available_at: str, rank: Sequence[str], attributes: Sequence[str] = (), bucket: Column | None = None, drop_unmatched: bool = False,
) -> DataFrame:
    """Each event with the change of its entity that was available by the event's time.

    Of all changes with ``available_at`` not after ``event_time`` the one with the largest ``rank`` columns (compared from
    the left) is taken, however old; a change that becomes available at the very time of the event counts. Result:
    ``keep`` columns of the event, then ``rank`` and ``attributes`` of the change (null without one, unless
    ``drop_unmatched``). A name that both sides use gets the suffix ``_known`` on the change's side. ``keep`` names what
    makes an event: copies equal in entity, time and ``keep`` come out once. Events with a null entity or time know
    nothing and come out with nulls, or not at all if ``drop_unmatched``. Changes with a null entity, null
    ``available_at`` or null first rank column are no changes. Changes of equal rank: the largest attribute values,
    from the left, win. ``bucket`` is the time bucket, an integer expression over the column ``at``, months by default.
    """
    bucket = month_number("at") if bucket is None else bucket
    best = [*rank, *attributes]
    names = [f"b{i}" for i in range(len(best))]
    labels = [f"{c}_known" if c in keep else c for c in best]
    kind = T.StructType([T.StructField(n, changes.schema[c].dataType) for n, c in zip(names, best)])
    kept = [f"k{i}" for i in range(len(keep))]

    e = events.select(F.col(event_entity).alias("entity"), F.col(event_time).cast("timestamp").alias("at"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    c = changes.where(F.col(change_entity).isNotNull() & F.col(available_at).isNotNull() & F.col(rank[0]).isNotNull())
    c = c.select(F.col(change_entity).alias("entity"), F.col(available_at).cast("timestamp").alias("at"), F.struct(*[F.col(x).alias(n) for x, n in zip(best, names)]).alias("best"))
    timed = e.where(F.col("entity").isNotNull() & F.col("at").isNotNull())
    empty = [F.lit(None).cast(events.schema[k].dataType).alias(n) for k, n in zip(keep, kept)]
    stream = timed.select("entity", "at", F.lit(2).alias("turn"), F.lit(None).cast(kind).alias("best"), *kept)
    stream = stream.unionByName(c.select("entity", "at", F.lit(1).alias("turn"), "best", *empty)).withColumn("bucket", bucket)
    # Copies of an event and changes of the same time become one row; all its columns are keys here, so that both uses of the
    # shuffled stream below need the same ones and share it.
    once = stream.where(F.col("bucket").isNotNull()).repartition("entity", "bucket").groupBy("entity", "bucket", "at", "turn", *kept).agg(F.max("best").alias("best"))

    earlier = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = once.groupBy("entity", "bucket").agg(F.max("best").alias("best"))
    before = per.select(F.col("entity").alias("e0"), F.col("bucket").alias("b0"), F.max("best").over(earlier).alias("before"))
    # Changes (1) precede events (2) of the same time.
    forward = Window.partitionBy("entity", "bucket").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    out = once.select("entity", "bucket", "at", "turn", F.max("best").over(forward).alias("inside"), *kept).where("turn = 2")
    out = out.join(before, (F.col("entity") == F.col("e0")) & (F.col("bucket") == F.col("b0"))).withColumn("best", F.greatest("inside", "before"))
    if drop_unmatched:
        out = out.where(F.col("best").isNotNull())
    columns = [*[F.col(n).alias(k) for n, k in zip(kept, keep)], *[F.col(f"best.{n}").alias(x) for n, x in zip(names, labels)]]
    out = out.select(*columns)
    if not drop_unmatched:
        untimed = e.where(F.col("entity").isNull() | F.col("at").isNull()).select("entity", "at", F.lit(None).cast(kind).alias("best"), *kept)
        out = out.unionByName(untimed.dropDuplicates(["entity", "at", *kept]).select(*columns))
    return out
