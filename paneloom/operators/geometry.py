"""Geometry of embedding vectors (array columns)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import fresh

#: Largest number of centroid components that goes to the workers (a table of that many doubles takes 64 MB).
MOST_COMPONENTS = 8_000_000
#: Later vectors of an entity's window that one task takes, rows up to which the list of larger windows is broadcast, and vectors that
#: are multiplied at a time.
NOVELTY_ROWS, BROADCAST_ROWS, BLOCK = 20_000, 100_000, 512


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column without nulls as rows of ``size`` doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(-1, size)


def is_finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def nearest_centroid(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with ``cluster`` and ``distance`` of the nearest of ``centroids`` (ties: the first), by an Arrow map over batches; a null
    vector has neither. The centroids, at most ``MOST_COMPONENTS`` numbers, go to the workers once. A made column whose name is taken
    gets a leading underscore."""
    c = np.array(centroids, float)
    if c.size > MOST_COMPONENTS:
        raise ValueError(f"{c.size} centroid components are too many to send")
    names = fresh(df, "cluster", "distance")
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.DoubleType())])
    at, shared = df.columns.index(vector), df.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            known = b.column(at).is_valid().to_numpy(zero_copy_only=False)
            x = _matrix(b.column(at).drop_null(), c.shape[1])
            cluster, distance = np.zeros(len(known), np.int32), np.zeros(len(known))
            best, near = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
            for i, centroid in enumerate(c):  # exact differences, not expanded squares
                d = np.sqrt(((x - centroid) ** 2).sum(1))
                closer = d < near
                best[closer], near[closer] = i, d[closer]
            cluster[known], distance[known] = best, near
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster, mask=~known), pa.array(distance, mask=~known)], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def cluster_spread(df: DataFrame, cluster: str, distance: str) -> DataFrame:
    """``spread`` and ``members`` of each cluster: its median distance; where that is 0, as in a cluster of one member that is its own
    centroid, the median of all clusters' medians, or a tiny number if that is 0 too."""
    by = df.groupBy(cluster).agg(F.median(distance).alias("spread"), F.count(F.lit(1)).alias("members"))
    middle = by.agg(F.median("spread")).first()[0] or 1e-6
    return by.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(float(middle))))


def fit_whitening(df: DataFrame, vector: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of a PCA whitening, from first and second moments: one pass. Each map task sends its sums row by row of the
    matrix and the cluster adds them up, so what comes to the driver is one matrix of dimension squared, whatever the number of
    partitions."""
    size = df.select(F.size(vector).alias("n")).where("n > 0").first()["n"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            x = np.concatenate([np.ones((b.num_rows, 1)), _matrix(b.column(0), size)], 1)
            total += x.T @ x
        if total[0, 0]:
            cells = pa.ListArray.from_arrays(pa.array(np.arange(size + 2) * (size + 1), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), cells], names=["row", "cells"])

    parts = df.where(is_finite(vector)).select(vector).mapInArrow(moments, "row int, cells array<double>")
    summed = parts.select("row", F.posexplode("cells").alias("at", "v")).groupBy("row", "at").agg(F.sum("v").alias("v"))
    lines = summed.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("cells")).orderBy("row").collect()
    total = np.array([r["cells"] for r in lines])
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    cov = (total[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    value, axis = np.linalg.eigh(cov)
    top = np.argsort(-value)[:dimensions]
    axis = axis[:, top] * np.sign(axis[np.abs(axis[:, top]).argmax(0), top])  # signs fixed by the largest component
    return mean, axis / np.sqrt(np.maximum(value[top], 1e-12))


def whiten(df: DataFrame, vector: str, mean: np.ndarray, projection: np.ndarray, into: str) -> DataFrame:
    """Centred, projected and scaled to length 1, as an Arrow map over batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (_matrix(b.column(at), len(mean)) - mean) @ projection
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * projection.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, tries: int = 4) -> list[list[float]]:
    """Centroids of the best of several k-means|| runs of Spark's own library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = df.select(array_to_vector(vector).alias("features")).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(points) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    points.unpersist()
    return [list(map(float, c)) for c in best.clusterCenters()]


def novelty(df: DataFrame, entity: str, day: str, vector: str, key: str, months: int = 24) -> DataFrame:
    """``key, novelty``: 1 - the largest cosine with an earlier vector of the entity within the last ``months`` calendar months
    (bound included); null without one, and for a null entity, day or vector. Vectors need length 1; ``key`` tells them apart.

    The range condition becomes a grouping by entity and window number: each vector meets only those of its own window of
    ``months`` months and of the one before. The later side of a window is cut into parts of some ``NOVELTY_ROWS`` vectors, and the
    earlier one is sent to each of them; a task holds one window of one entity as a matrix, multiplies it block by block and keeps
    the largest product per vector, so no pair is ever a row."""
    number = lambda d: F.floor((F.year(d) * 12 + F.month(d)) / months).cast("int")
    rows = df.select(F.col(key).alias("k"), F.col(entity).alias("e"), F.col(day).alias("d"), F.col(vector).alias("v"))
    rows = rows.where(F.col("e").isNotNull() & F.col("d").isNotNull() & F.col("v").isNotNull())
    since = F.unix_date(F.add_months("d", -months))
    late = rows.select("e", F.explode(F.array(number("d"), number("d") - 1)).alias("w"), "k", F.unix_date("d").alias("d"), since.alias("since"), "v")
    early = rows.select(F.col("e").alias("e0"), number("d").alias("w0"), F.unix_date("d").alias("d0"), F.col("v").alias("v0"))
    large = late.groupBy("e", "w").agg(F.ceil(F.count(F.lit(1)) / NOVELTY_ROWS).cast("int").alias("parts")).where("parts > 1")
    known = large.limit(BROADCAST_ROWS + 1).collect()
    if known:
        side = F.broadcast(df.sparkSession.createDataFrame(known, large.schema)) if len(known) <= BROADCAST_ROWS else large
        parts = F.coalesce("parts", F.lit(1))
        late = late.join(side, ["e", "w"], "left").withColumn("p", F.pmod(F.xxhash64("k"), parts).cast("int")).drop("parts")
        early = early.join(side.withColumnsRenamed({"e": "e0", "w": "w0"}), ["e0", "w0"], "left").withColumn("p0", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        late, early = late.withColumn("p", F.lit(0)), early.withColumn("p0", F.lit(0))
    kind = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("cosine", T.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"k": left["k"].slice(0, 0), "cosine": pa.array([], pa.float64())})
        days, known = right["d0"].to_numpy(), right["v0"].combine_chunks()
        size = len(known[0])
        b = _matrix(known, size)
        order = np.argsort(days, kind="stable")
        days, b = days[order], b[order]
        a, d, first = left["v"].combine_chunks(), left["d"].to_numpy(), left["since"].to_numpy()
        best = np.full(len(d), np.nan)
        for start in range(0, len(d), BLOCK):
            now = slice(start, start + BLOCK)
            lo, hi = np.searchsorted(days, first[now]), np.searchsorted(days, d[now])  # days from "since" on, before the vector's own
            if lo.min() >= hi.max():
                continue
            cosine = _matrix(a.slice(start, BLOCK), size) @ b[lo.min() : hi.max()].T
            place = np.arange(lo.min(), hi.max())[None, :]
            cosine[(place < lo[:, None]) | (place >= hi[:, None])] = -np.inf
            best[now] = np.where(hi > lo, cosine.max(1), np.nan)
        found = ~np.isnan(best)
        return pa.table({"k": left["k"].filter(pa.array(found)), "cosine": pa.array(best[found])})

    met = late.groupBy("e", "w", "p").cogroup(early.groupBy("e0", "w0", "p0")).applyInArrow(meet, kind)
    best = met.groupBy("k").agg((1 - F.max("cosine")).alias("novelty"))
    return df.select(key).join(best.withColumnRenamed("k", key), key, "left")
