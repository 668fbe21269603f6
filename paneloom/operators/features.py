"""Per-entity feature tables from events, kept as cumulative daily totals.

The store has one row per entity, event type and day with the running count and running totals up to that day. Any
window feature is the difference of the running values at its two ends, each taken as of the last stored day not after
it; the newest timestamp up to the end gives recency. Days can be appended without reading old events again.

Shuffles: the events once, by entity, day and a share of the ids (one hot entity spreads over its days, one hot day over
``DAY_PARTS`` tasks), compact and before their types are spread out; the day rows once, by entity and type (at most
``DAY_PARTS`` rows per day, however many events a day has); the (entity, type) rows once, for the wide table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.session import materialize

#: Tasks that one day of one entity is spread over before its events are added up.
DAY_PARTS = 16
_ITEM = r"(?<![0-9.])(\d{1,2}\.\d{2})(?![0-9])"
_LETTER = _ITEM + r"[\s\-(]*([a-z])(?![a-z0-9])"


def item_type(label: Column | str) -> Column:
    """The canonical name of an item label: its number, with the paragraph letter in brackets if it has one
    (``ITEM 5.02 (B)`` and ``5.02-b.`` give ``5.02(b)``); null if the label has no item number."""
    c = F.lower(F.col(label) if isinstance(label, str) else label)
    number, letter = F.regexp_extract(c, _ITEM, 1), F.regexp_extract(c, _LETTER, 2)
    return F.when(number == "", None).when(letter == "", number).otherwise(F.concat(number, F.lit("("), letter, F.lit(")")))


def daily_totals(events: DataFrame, entity: str, types: str, time: str, event_id: str, totals: Sequence[str] = ()) -> DataFrame:
    """One row per entity, type and day: ``entity, event_type, day, n, <totals>, newest, newest_id``.

    ``types`` is an array of canonical type names. Copies of an event (same id, entity and time) count once, with the
    largest of their totals; without an id, events of one entity, type and time are copies of each other. ``newest_id``
    belongs to the newest time of the day, of equals the smallest. Left out, as they belong to no row: events with a
    null entity, a null time or no type. Null totals add nothing. No events give no rows. Totals can't be named like the
    store's own columns.
    """
    if taken := {"entity", "event_type", "day", "n", "newest", "newest_id"} & {t.lower() for t in totals}:
        raise ValueError(f"reserved names: {sorted(taken)}")
    e = events.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & (F.size(types) > 0)).select(
        F.col(entity).alias("entity"), F.to_date(time).alias("day"), F.col(time).cast("timestamp").alias("at"), F.col(event_id).alias("id"),
        F.array_distinct(types).alias("types"), *[F.col(c).alias(f"total_{i}") for i, c in enumerate(totals)],
    )
    sums = [f"total_{i}" for i in range(len(totals))]
    part = F.pmod(F.xxhash64("at", "id"), F.lit(DAY_PARTS)).cast("int")  # copies agree in it
    spread = e.withColumn("part", part).repartition("entity", "day", "part").select("entity", "day", "part", "at", "id", F.explode("types").alias("event_type"), *sums)
    once = spread.where(F.col("event_type").isNotNull()).groupBy("entity", "day", "part", "event_type", "at", "id")
    once = once.agg(*[F.max(c).alias(c) for c in sums]) if sums else once.agg(F.lit(1).alias("one"))
    newest = F.min(F.struct((-F.unix_micros("at")).alias("back"), F.col("id")))
    parts = once.groupBy("entity", "day", "part", "event_type").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums], newest.alias("newest"))
    # Partitioned as the store's windows need it, so that adding up the parts and the running totals share one shuffle.
    whole = parts.repartition("entity", "event_type").groupBy("entity", "event_type", "day")
    daily = whole.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], F.min("newest").alias("newest"))
    return daily.select(
        "entity", "event_type", "day", "n", *[F.coalesce(c, F.lit(0)).alias(name) for c, name in zip(sums, totals)],
        F.timestamp_micros(-F.col("newest.back")).alias("newest"), F.col("newest.id").alias("newest_id"),
    )


def cumulative_store(daily: DataFrame, totals: Sequence[str] = ()) -> DataFrame:
    """The store: ``daily`` with ``n`` and ``totals`` replaced by their running sums over the days of entity and type."""
    w = Window.partitionBy("entity", "event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("entity", "event_type", "day", *[F.sum(c).over(w).alias(c) for c in ("n", *totals)], "newest", "newest_id")


def as_of_features(store: DataFrame, as_of: str, totals: Sequence[str] = (), windows: dict[str, int] | None = None) -> DataFrame:
    """One row per entity and type with a stored day not after ``as_of``: ``n``, ``<totals>`` since the beginning,
    ``n_<w>``, ``<total>_<w>`` over the last ``windows[w]`` days (both from endpoint subtraction), ``newest`` and
    ``newest_id``."""
    end = F.lit(as_of).cast("date")

    def at(column: str, last: Column) -> Column:
        return F.coalesce(F.max_by(F.when(F.col("day") <= last, F.col(column)), F.when(F.col("day") <= last, F.col("day"))), F.lit(0))

    made = [at(c, end).alias(c) for c in ("n", *totals)]
    for name, days in (windows or {}).items():
        made += [(at(c, end) - at(c, F.date_sub(end, days))).alias(f"{c}_{name}") for c in ("n", *totals)]
    upto = store.where(F.col("day") <= end)
    recent = F.max(F.struct("newest", "day", "newest_id"))
    out = upto.groupBy("entity", "event_type").agg(*made, recent.alias("recent"))
    return out.select(*[c for c in out.columns if c != "recent"], F.col("recent.newest").alias("newest"), F.col("recent.newest_id").alias("newest_id"))


def wide_features(features: DataFrame, values: Sequence[str], counts: Sequence[str] = (), types: Sequence[str] = (), max_types: int = 2000) -> DataFrame:
    """One row per entity with the columns ``t_<type>_<value>`` for each of ``types`` and each other type that occurs, and each of
    ``values``, anything but letters and digits of the type written as ``_`` (``t_5_02_b_n``); an entity without a type has zero in
    the columns named in ``counts`` and null in the others. With ``types`` the columns do not depend on the data as long as
    no other type occurs. More than ``max_types`` types are refused, not cut."""
    features = materialize(features.select("entity", "event_type", *values), "features")
    occur = [r[0] for r in features.select("event_type").distinct().limit(max_types + 1).collect()]
    named = [*dict.fromkeys([*types, *sorted(occur)])]
    if len(named) > max_types:
        raise ValueError(f"more than {max_types} event types: keep the long form")
    types = [*dict.fromkeys("t_" + re.sub("[^0-9A-Za-z]+", "_", t).strip("_") for t in named)]
    if len(types) < len(named):
        raise ValueError("different event types would get the same column name")
    if not types:
        return features.select("entity").distinct()
    column = F.concat(F.lit("t_"), F.regexp_replace(F.regexp_replace("event_type", "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    # Times and dates are pivoted as numbers, which lets Spark fill the cells by position in one hash aggregate; a pivot over
    # a single aggregate would leave its name out of the columns' names, so there is a spare one.
    kinds = {v: features.schema[v].dataType.simpleString() for v in values}
    coded = {"timestamp": "unix_micros({})", "date": "unix_date({})"}
    decoded = {"timestamp": "timestamp_micros({})", "date": "date_from_unix_date(cast({} as int))"}
    cells = [F.first(F.expr(coded.get(kinds[v], "{}").format(f"`{v}`")), ignorenulls=True).alias(v) for v in values]
    wide = features.withColumn("column", column).groupBy("entity").pivot("column", types).agg(*cells, F.count(F.lit(1)).alias("rows"))
    shown = ["entity"]
    for t in types:
        for v in values:
            cell = decoded.get(kinds[v], "{}").format(f"`{t}_{v}`")
            shown.append(f"{f'coalesce({cell}, 0)' if v in counts else cell} as `{t}_{v}`")
    return wide.selectExpr(*shown)
