"""Percentiles per group of very large columns: distributed multi-select, and summaries that can be put together.

:func:`multi_select` finds exact order statistics. Values are packed into sorted chunks and moved once, to the place that a
hash of their group gives (a large group has many places); after that they stay where they are. Then, round by round, each
partition proposes the median of the values still possible for a wanted rank, the weighted median of the proposals
becomes the pivot, the values below, at and above it are counted, and the range that cannot hold the rank is discarded.
Ranks of a group that have the same range left share its pivot. A range with few values left is read off directly.
Every round discards at least a quarter of what is left of a range and usually half, so n values take some log2(n / finish)
rounds; a round moves the open ranges to the chunks and one proposal and one count per partition and range back, never values.

:func:`summarize` keeps evenly spaced order statistics of each part (a partition, a day, a delivery), and
:func:`merge_summaries` adds the parts up, also with parts taken away again, giving each percentile with a bound of its
rank error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import finite
from paneloom.session import discard, materialize, materialize_bucketed

#: Values that a Python worker holds before it sorts and emits them as chunks.
BUFFER = 1 << 18
#: (length of a chunk, places that chunks of at least this length of a group are spread over): the larger a group's share of a
#: buffer, the more places it gets, so that a group of a third of all values is not one task.
PLACES = ((1 << 13, 256), (1 << 8, 16), (0, 1))
#: A range of ranks still possible: that many values are at or below its lower end, that many inside it.
RANGE = ["gid", "below", "left"]


def _packer(names: Sequence[str]):
    """(gid, value, group columns) rows to (gid, slot, n, sorted values, group columns) chunks of at most BUFFER values. The slot is
    the group's id with the number of one of its places."""

    def flush(batches: list[pa.RecordBatch], turn: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        code, x = coded.indices.to_numpy(zero_copy_only=False), table.column(1).to_numpy()
        order = np.lexsort((x, code))
        code, x = code[order], x[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.diff(np.append(at, len(x)))
        gids = coded.dictionary.take(pa.array(code[at]))
        places = np.select([n >= least for least, _ in PLACES], [many for _, many in PLACES])
        slots = [f"{g}|{turn % many}" for g, many in zip(gids.to_pylist(), places)]
        chunks = pa.ListArray.from_arrays(pa.array(np.append(at, len(x)), pa.int32()), pa.array(x))
        first = pa.array(order[at])
        return pa.RecordBatch.from_arrays([gids, pa.array(slots, pa.string()), pa.array(n, pa.int64()), chunks, *[table.column(2 + i).take(first).combine_chunks() for i in range(len(names))]], names=["gid", "slot", "n", "chunk", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, turn = [], 0, 7 * TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BUFFER:
                yield flush(held, turn)
                held, rows, turn = [], 0, turn + 1
        if held:
            yield flush(held, turn)

    return run


def _wanted(row: int, offsets: np.ndarray, fields: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    return tuple(f[offsets[row] : offsets[row + 1]] for f in fields)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, tuple[np.ndarray, ...]]]:
    """(gid, sorted values, wants) of each chunk; wants are columns as given to ``over``."""
    for batch in batches:
        gids, chunks, wants = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        offsets, values = chunks.offsets.to_numpy(), chunks.values.to_numpy(zero_copy_only=False)
        ends, fields = wants.offsets.to_numpy(), [f.to_numpy(zero_copy_only=False) for f in wants.values.flatten()]
        for row, gid in enumerate(gids):
            yield gid, values[offsets[row] : offsets[row + 1]], _wanted(row, ends - wants.values.offset if wants.values.offset else ends, fields)


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One proposal per partition and range: the weighted median of the chunks' medians, with the number of values still
    possible."""
    found: dict[tuple[str, int, int], list[tuple[float, int]]] = {}
    for gid, x, (below, left, lo, hi) in _chunks(batches):
        a, b = np.searchsorted(x, lo, side="right"), np.searchsorted(x, hi, side="left")
        for k, m, i, j in zip(below.tolist(), left.tolist(), a.tolist(), b.tolist()):
            if j > i:
                found.setdefault((gid, k, m), []).append((float(x[i + (j - i - 1) // 2]), j - i))
    out = []
    for key, proposals in found.items():
        proposals.sort()
        weight = np.cumsum([w for _, w in proposals])
        out.append((*key, proposals[int(np.searchsorted(weight * 2, weight[-1]))][0], int(weight[-1])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*RANGE, "median", "weight"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a range below and at its pivot, per partition and range."""
    totals: dict[tuple[str, int, int], list[int]] = {}
    for gid, x, (below, left, lo, pivot) in _chunks(batches):
        a, b, c = np.searchsorted(x, lo, side="right"), np.searchsorted(x, pivot, side="left"), np.searchsorted(x, pivot, side="right")
        for k, m, less, same in zip(below.tolist(), left.tolist(), (b - a).tolist(), (c - b).tolist()):
            t = totals.setdefault((gid, k, m), [0, 0])
            t[0] += less
            t[1] += same
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*k, *t) for k, t in totals.items()])], names=[*RANGE, "less", "same"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each range, per chunk."""
    for batch in batches:
        made: list[tuple[str, int, int]] = []
        parts: list[np.ndarray] = []
        for gid, x, (below, left, lo, hi) in _chunks(iter([batch])):
            a, b = np.searchsorted(x, lo, side="right"), np.searchsorted(x, hi, side="left")
            for k, m, i, j in zip(below.tolist(), left.tolist(), a.tolist(), b.tolist()):
                if j > i:
                    made.append((gid, k, m))
                    parts.append(x[i:j])
        if made:
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in zip(*made)], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)))], names=[*RANGE, "rest"])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks without the ranges that no wanted rank can lie in any more."""
    for batch in batches:
        slots = iter(batch.column(3).to_pylist())
        for (gid, x, (_, _, lo, hi)), slot in zip(_chunks(iter([batch])), slots):
            a, b = np.searchsorted(x, lo, side="right"), np.searchsorted(x, hi, side="left")
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, np.maximum(a, b), -1)
            kept = x[np.cumsum(edge[:-1]) > 0]
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([slot]), pa.array([len(kept)], pa.int64()), pa.array([kept], pa.list_(pa.float64()))], names=["gid", "slot", "n", "chunk"])


def chunk_table(df: DataFrame, group: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Finite values as chunks (``gid, slot, n, chunk``), written once by slot, and the groups (``group, _gid, _n``). The input is read
    once: the groups and their sizes come from the chunks."""
    names = [f"g{i}" for i in range(len(group))]
    keyed = df.select(finite(value).alias("value"), *[F.col(c).alias(n) for c, n in zip(group, names)]).where(F.col("value").isNotNull())
    gid = F.to_json(F.struct(*names)) if group else F.lit("{}")
    # Zero is written without a sign, so that the two zeros are one value.
    rows = keyed.select(gid.alias("gid"), (F.col("value") + F.lit(0.0)).alias("value"), *names)
    kinds = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, group)]
    schema = T.StructType([T.StructField("gid", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("n", T.LongType()), T.StructField("chunk", T.ArrayType(T.DoubleType())), *kinds])
    chunks = materialize_bucketed(rows.mapInArrow(_packer(names), schema), "slot", "chunks")
    groups = chunks.groupBy("gid").agg(F.sum("n").alias("_n"), *[F.first(n).alias(n) for n in names])
    groups = groups.select(*[F.col(n).alias(c) for n, c in zip(names, group)], F.col("gid").alias("_gid"), "_n")
    return chunks.select("gid", "slot", "n", "chunk"), materialize(groups, "groups")


def multi_select(chunks: DataFrame, wanted: DataFrame, finish: int = 512, compact_every: int = 4) -> DataFrame:
    """``gid, rank, value``: of the values in ``chunks`` (of :func:`chunk_table`) the value of each 0-based ``rank`` of
    ``wanted`` (``gid, n, rank``; n is the group's number of values), exactly.

    A range with at most ``finish`` values left is gathered (that many values, whatever the size of the group) and its ranks read
    off; above that, rounds go on. After ``compact_every`` rounds the chunks are rewritten without the discarded ranges.
    Any number of groups and ranks takes the same way: no table is broadcast.
    """
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    state = wanted.select("gid", F.col("rank").cast("long").alias("rank"), lowest.alias("lo"), highest.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").cast("long").alias("left"), F.lit(None).cast("double").alias("value"))
    state = materialize(state.distinct(), "ranks")
    slots = materialize(chunks.select("gid", "slot").distinct(), "slots")

    def ranges(ranks: DataFrame) -> DataFrame:
        return ranks.groupBy(*RANGE).agg(F.min(F.struct("lo", "hi")).alias("_r")).select(*RANGE, "_r.lo", "_r.hi")

    def over(wants: DataFrame, *fields: str) -> DataFrame:
        """Chunks beside the ranges of their group. These are sent to the group's slots; the chunks lie there already."""
        by = wants.groupBy("gid").agg(F.collect_list(F.struct("below", "left", *fields)).alias("wants"))
        there = by.join(slots.hint("merge"), "gid").select("slot", "wants")
        return chunks.join(there.hint("shuffle_hash"), "slot").select("gid", "chunk", "wants", "slot")

    kind = "gid string, below long, left long, "
    rounds = 0
    is_open = F.col("value").isNull() & (F.col("left") > finish)
    while state.where(is_open).limit(1).count():
        proposals = over(ranges(state.where(is_open)), "lo", "hi").mapInArrow(_propose, kind + "median double, weight long")
        w = Window.partitionBy(*RANGE)
        running = F.sum("weight").over(w.orderBy("median").rowsBetween(Window.unboundedPreceding, 0))
        ranked = proposals.select(*RANGE, "median", (running * 2 >= F.sum("weight").over(w)).alias("enough"))
        pivots = ranked.where("enough").groupBy(*RANGE).agg(F.min("median").alias("pivot"))
        aimed = materialize(ranges(state.where(is_open)).join(pivots.hint("merge"), RANGE), "pivots")
        counts = over(aimed, "lo", "pivot").mapInArrow(_count, kind + "less long, same long")
        counts = aimed.select(*RANGE, "pivot").join(counts.groupBy(*RANGE).agg(F.sum("less").alias("less"), F.sum("same").alias("same")).hint("merge"), RANGE)
        c = state.where(is_open).join(counts.hint("merge"), RANGE)
        lower = F.col("rank") < F.col("below") + F.col("less")
        hit = ~lower & (F.col("rank") < F.col("below") + F.col("less") + F.col("same"))
        after = c.select(
            "gid", "rank", F.when(lower | hit, F.col("lo")).otherwise(F.col("pivot")).alias("lo"), F.when(lower, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(lower | hit, F.col("below")).otherwise(F.col("below") + F.col("less") + F.col("same")).alias("below"),
            F.when(lower, F.col("less")).when(hit, F.lit(0)).otherwise(F.col("left") - F.col("less") - F.col("same")).alias("left"), F.when(hit, F.col("pivot")).alias("value"),
        )
        old, state = state, materialize(state.where(~is_open).unionByName(after), "ranks")
        discard(old)
        discard(aimed)
        rounds += 1
        if rounds % compact_every == 0:
            unknown = ranges(state.where(F.col("value").isNull()))
            smaller = over(unknown, "lo", "hi").mapInArrow(_compact, "gid string, slot string, n long, chunk array<double>")
            chunks = materialize_bucketed(smaller, "slot", "chunks")
    unknown = state.where(F.col("value").isNull())
    rest = over(ranges(unknown), "lo", "hi").mapInArrow(_rest, kind + "rest array<double>")
    rest = rest.groupBy(*RANGE).agg(F.sort_array(F.flatten(F.collect_list("rest"))).alias("rest"))
    asked = unknown.groupBy(*RANGE).agg(F.collect_list("rank").alias("ranks"))
    read = F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.element_at("rest", (r - F.col("below") + 1).cast("int")).alias("value")))
    left = asked.join(rest.hint("merge"), RANGE).select("gid", F.explode(read).alias("x")).select("gid", "x.rank", "x.value")
    return state.where(F.col("value").isNotNull()).select("gid", "rank", "value").unionByName(left)


def percentiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], **options: int) -> DataFrame:
    """``group, n, prob, percentile``: the percentiles of the finite values of each group, between neighbouring values by
    linear interpolation. They are exact: the rank error is 0 whatever the number of values and partitions.

    Nulls, NaN and infinities are no values; a group without values has no rows; null is a group like any other; equal
    values count as often as they occur.
    """
    if taken := {"n", "prob", "percentile"} & {c.lower() for c in group}:
        raise ValueError(f"reserved names: {sorted(taken)}")
    chunks, groups = chunk_table(df, group, value)
    spot = (F.col("_n") - 1) * F.col("_p")
    each = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    wanted = groups.select("_gid", "_n", each.alias("_p")).select(F.col("_gid").alias("gid"), F.col("_n").alias("n"), F.explode(F.array(F.floor(spot), F.ceil(spot))).alias("rank"))
    found = multi_select(chunks, wanted, **options)
    table = found.groupBy(F.col("gid").alias("_gid")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    out = groups.join(table.hint("merge"), "_gid").withColumn("_p", each)
    low, high = F.col("_v")[F.floor(spot)], F.col("_v")[F.ceil(spot)]
    return out.select(*group, F.col("_n").alias("n"), F.col("_p").alias("prob"), (low + (high - low) * (spot - F.floor(spot))).alias("percentile"))


def summarize(df: DataFrame, group: Sequence[str], value: str, steps: int = 64, **options: int) -> DataFrame:
    """``group, n, rank, value``: of each group the values at the ``steps + 1`` evenly spaced 0-based ranks from 0 to n - 1
    (all values if n is not larger), found by :func:`multi_select`. Neighbouring ranks are at most n / ``steps`` + 1 apart."""
    chunks, groups = chunk_table(df, group, value)
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda j: F.round(j * (F.col("_n") - 1) / F.lit(steps)).cast("long")))
    wanted = groups.select(F.col("_gid").alias("gid"), F.col("_n").alias("n"), F.explode(spots).alias("rank"))
    found = multi_select(chunks, wanted, **options).withColumnsRenamed({"gid": "_gid", "rank": "_rank", "value": "_value"})
    out = groups.join(found.hint("merge"), "_gid")
    return out.select(*group, F.col("_n").alias("n"), F.col("_rank").alias("rank"), F.col("_value").alias("value"))


def merge_summaries(summaries: DataFrame, part: Sequence[str], group: Sequence[str], probs: Sequence[float], sign: str | None = None) -> DataFrame:
    """``group, n, prob, percentile, rank_error``: percentiles of all parts of a group together, from their summaries.

    ``part`` tells the summaries of a group apart (part + group as given to :func:`summarize`); with ``sign`` a part of -1 is
    taken away again (rows that a correction replaced). A summary bounds from both sides how many of its values are not
    above any given one; the bounds add up, so each answer has a proven ``rank_error``: the value given is at most so many
    places, of n, from the wanted one. It is at most half the sum of the parts' steps, about n / (2 * steps), and 0 where
    all parts are complete. Answers are values that occur in some part.
    """
    s = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
    inside = Window.partitionBy(*group, *part, *([sign] if sign else [])).orderBy("rank")
    least = F.col("rank") - F.coalesce(F.lag("rank").over(inside), F.lit(-1))
    most = F.coalesce(F.lead("rank").over(inside), F.col("n")) - F.when(F.lag("rank").over(inside).isNull(), F.lit(0)).otherwise(F.col("rank"))
    points = summaries.select(*group, F.col("value").alias("_v"), s.alias("_s"), F.when(F.col("rank") == 0, F.col("n")).alias("_n"), least.alias("_l"), most.alias("_u"))
    low, high = F.when(F.col("_s") > 0, F.col("_l")).otherwise(-F.col("_u")), F.when(F.col("_s") > 0, F.col("_u")).otherwise(-F.col("_l"))
    at = points.groupBy(*group, "_v").agg(F.sum(low).alias("_l"), F.sum(high).alias("_u"), F.sum(F.col("_s") * F.coalesce("_n", F.lit(0))).alias("_n"))
    along = Window.partitionBy(*group).orderBy("_v")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group))).withColumn("_low", F.sum("_l").over(upto)).withColumn("_high", F.sum("_u").over(upto))
    at = at.withColumn("_before", F.coalesce(F.lag("_high").over(along), F.lit(0))).where("_total > 0")
    asked = at.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    place = F.floor((F.col("_total") - 1) * F.col("_p")) + 1
    error = F.greatest(F.lit(0), place - F.col("_low"), F.col("_before") + 1 - place)
    best = F.min(F.struct(error.alias("error"), F.col("_v").alias("v")))
    out = asked.groupBy(*group, "_p", "_total").agg(best.alias("_best"))
    return out.select(*group, F.col("_total").alias("n"), F.col("_p").alias("prob"), F.col("_best.v").alias("percentile"), F.col("_best.error").cast("long").alias("rank_error"))
