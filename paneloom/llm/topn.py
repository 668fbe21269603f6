"""The N highest-scoring items of every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import fresh


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """For each row but the first, whether its first ``keys`` columns differ from the row before; nulls and NaN equal
    themselves."""
    new = np.zeros(batch.num_rows - 1, bool)
    for i in range(keys):
        column = batch.column(i)
        a, b = column.slice(0, batch.num_rows - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):
            differ &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
        new |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def first_of_runs(keys: int, n: int):
    """A function over Arrow batches that lets the first ``n`` rows of each run of equal leading ``keys`` columns through.
    It holds one row of the batch before and a count, never a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            head = joined.num_rows - batch.num_rows
            start = np.concatenate([[last is None], _starts(joined, keys)])[head:] if joined.num_rows > 1 else np.array([True])
            place = np.arange(batch.num_rows)
            opened = np.maximum.accumulate(np.where(start, place, -1))
            rank = np.where(opened >= 0, place - opened, place + seen)
            kept = np.flatnonzero(rank < n)
            if len(kept):
                yield batch.take(pa.array(kept))
            seen, last = int(rank[-1]) + 1, batch.slice(batch.num_rows - 1)

    return run


def top_n(df: DataFrame, group: Sequence[str], score: str, n: int, ties: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The ``n`` rows of largest (or smallest) ``score`` of each ``group``, all rows of smaller groups; columns as in ``df``.

    Rows of equal score are taken in the order of the ``ties`` columns, then of all other columns that can be sorted, so
    the result is the same on every run; repeated rows count as several items. Null and NaN scores come after all numbers.
    Null is a group like any other. ``n`` of 0 or less and empty tables give no rows.

    Each input partition is sorted and cut to ``n`` rows per group before anything is shuffled: a group of any size sends
    at most ``n`` rows per partition to its place, where they are sorted and cut again. Sorts spill to disk; Python sees
    a stream of Arrow batches.
    """
    if n <= 0:
        return df.limit(0)
    sortable = lambda t: not isinstance(t, (T.MapType, T.VariantType))
    rest = [f.name for f in df.schema if f.name not in {*group, *ties, score} and sortable(f.dataType)]
    (unknown,) = fresh(df, "score_unknown")
    s = F.col(score)
    floating = isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType))
    order = [*group, *[c for c in df.columns if c not in group]]
    rows = df.select(*order, (s.isNull() | F.isnan(s) if floating else s.isNull()).alias(unknown))
    sort = [*[F.col(c) for c in group], F.col(unknown), s.desc() if largest else s.asc(), *[F.col(c) for c in (*ties, *rest)]]
    cut = first_of_runs(len(group), n)
    local = rows.sortWithinPartitions(*sort).mapInArrow(cut, rows.schema)
    whole = local.repartition(*[F.col(c) for c in group]) if group else local.coalesce(1)
    return whole.sortWithinPartitions(*sort).mapInArrow(cut, rows.schema).select(*df.columns)
