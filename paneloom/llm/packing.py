"""Filling containers of fixed capacity with items, by bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import fresh


class OpenBins:
    """At most ``limit`` open containers. A bit set holds the amounts of free space that occur among them, so the best fit
    (the least free space that is enough) is the lowest set bit at or above the item's size."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, size: int) -> int:
        """The number of the container that gets an item of ``size`` (1 to capacity)."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:  # a full one closes at once
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number


def pack(items: DataFrame, size: str, capacity: int, order: list[str], open_bins: int = 512, shard_items: int = 200_000, rows: int | None = None) -> DataFrame:
    """``items`` with ``piece, offset, length, container``: which part of the item lies in which container.

    An item of at most ``capacity`` is one piece. A larger one is cut into pieces of exactly ``capacity``, each a container of
    its own, and a rest that is packed like an item. Null, zero and negative sizes need no room: one row with length 0 and
    a null container. No container holds more than ``capacity``; no row is dropped.

    Items are spread over shards of about ``shard_items`` by a hash of the ``order`` columns and packed shard by shard in
    the order of another hash, so the result depends only on the items, not on their layout or on lost tasks. Items equal in ``order`` and
    size are interchangeable. Each shard leaves at most ``open_bins`` containers open. Only ``items`` without their texts should come here.
    ``container`` numbers are unique: shard * 2^32 + number. A made column whose name is taken gets a leading underscore.
    """
    rows = items.count() if rows is None else rows
    shards = max(1, -(-rows // shard_items))
    shard, turn, row = fresh(items, "shard", "turn", "row_size")
    made = fresh(items, "piece", "offset", "length", "container")
    keyed = items.select("*", F.pmod(F.xxhash64(F.lit(1), *order), F.lit(shards)).cast("long").alias(shard), F.xxhash64(F.lit(2), *order).alias(turn), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(row))
    # All rows of a shard meet in one partition, in an order that does not depend on where they came from.
    sort = [shard, turn, *order, row]
    together = keyed.repartition(min(shards, 4 * max(1, items.sparkSession.sparkContext.defaultParallelism)), shard).sortWithinPartitions(*sort)
    width = len(items.columns)
    schema = T.StructType([*items.schema.fields, *[T.StructField(name, kind) for name, kind in zip(made, (T.IntegerType(), T.LongType(), T.LongType(), T.LongType()))]])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            source, piece, offset, length, container = [], [], [], [], []
            for i, (s, n) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 2).to_pylist())):
                if s != current:
                    current, bins = s, OpenBins(capacity, open_bins)
                if n <= 0:
                    source.append(i), piece.append(0), offset.append(0), length.append(0), container.append(None)
                    continue
                full, rest = divmod(n, capacity)
                for p in range(full + bool(rest)):
                    some = capacity if p < full else rest
                    source.append(i), piece.append(p), offset.append(p * capacity), length.append(some)
                    container.append((s << 32) + bins.put(some))
            kept = [c.take(pa.array(np.array(source, np.int64))) for c in batch.columns[:width]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(container, pa.int64())], names=[f.name for f in schema])

    return together.mapInArrow(fill, schema)
