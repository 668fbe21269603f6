"""Mixing sources to target shares of the tokens, by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.columns import fresh

#: Up to this many (source, length) pairs the plan of the mixture is broadcast: some 20 MB.
BROADCAST_PAIRS = 500_000


def source_name(source: Column | str) -> Column:
    """A source however it is written: lower case, blanks and hyphens as ``_``; null if nothing is left."""
    c = F.lower(F.trim(F.col(source) if isinstance(source, str) else source))
    c = F.regexp_replace(c, r"[\s\-_]+", "_")
    return F.when(c != "", c)


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int = 42) -> tuple[np.ndarray, int]:
    """How many documents of each length to take, at most ``counts`` of each, so that the tokens come as close to ``budget`` as
    can be without going over it, and the tokens taken.

    Each length first gets the same share of its documents, rounded down, which keeps the mixture of lengths; then single
    documents of the lengths that lost most by rounding, until what remains of the budget is a few of the longest
    documents. A bounded-knapsack dynamic programme over the lengths closes the rest; it stops as soon as the rest is met exactly.
    """
    length, count = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return count.copy(), total
    if budget <= 0 or not len(length):
        return np.zeros_like(count), 0
    share = count * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), count)
    rest = budget - int((length * take).sum())
    while rest < 0:  # only by rounding of very large numbers
        i = int(np.argmax(take > 0))
        take[i] -= 1
        rest += int(length[i])
    room = 2 * int(length.max())
    for i in np.argsort(-(share - take), kind="stable"):
        if rest <= room:
            break
        if take[i] < count[i] and length[i] <= rest:
            take[i] += 1
            rest -= int(length[i])
    # reachable[i]: bit w is set if the lengths before the i-th step can make up w of the rest.
    left = count - take
    order = np.random.default_rng(seed).permutation(len(length))
    reachable, steps = [1], []
    for i in order:
        many = min(int(left[i]), rest // int(length[i]))
        block = 1
        while many > 0 and not reachable[-1] >> rest & 1:
            block = min(block, many)
            now = (reachable[-1] | reachable[-1] << (block * int(length[i]))) & ((1 << (rest + 1)) - 1)
            if now != reachable[-1]:
                reachable.append(now)
                steps.append((int(i), block))
            many -= block
            block *= 2
    at = reachable[-1].bit_length() - 1
    missed = rest - at
    for (i, block), before in zip(reversed(steps), reversed(reachable[:-1])):
        if not before >> at & 1:
            take[i] += block
            at -= block * int(length[i])
    return take, budget - missed


def plan_mixture(histogram: dict[str, tuple[np.ndarray, np.ndarray]], targets: dict[str, tuple[float, int]], seed: int = 42) -> tuple[dict[str, tuple[int, np.ndarray]], list[dict]]:
    """For each source the whole repeats of all its documents and the documents of each length to take once more; and the
    report of target and actual shares. The size of the mixture is that of all listed sources with each document once."""
    sizes = {s: int((histogram[s][0] * histogram[s][1]).sum()) if s in histogram else 0 for s in targets}
    total = sum(sizes.values())
    plan, report = {}, []
    for s, (share, most) in targets.items():
        lengths, counts = histogram.get(s, (np.empty(0, np.int64), np.empty(0, np.int64)))
        budget = int(share * total)
        repeats = min(most, budget // sizes[s]) if sizes[s] else 0
        extra, tokens = fit_budget(lengths, counts, budget - repeats * sizes[s], seed) if repeats < most else (np.zeros_like(counts), 0)
        plan[s] = (int(repeats), extra)
        tokens += repeats * sizes[s]
        report.append({"source": s, "target_share": float(share), "max_repeats": int(most), "source_tokens": sizes[s], "budget": budget, "tokens": tokens, "limited": tokens == sizes[s] * most and tokens < share * total})
    mixed = sum(r["tokens"] for r in report)
    for r in report:
        r["actual_share"] = r["tokens"] / mixed if mixed else None
    return plan, report


REPORT = "source string, target_share double, max_repeats int, source_tokens long, budget long, tokens long, limited boolean, actual_share double"


def make_plan(sizes: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[dict, dict, list[dict]]:
    """Histogram, plan and report for documents ``source, n_tokens``. What comes to the driver is the number of documents per
    listed source and exact length: bounded by sources times the longest text, whatever the number of documents. Targets with a
    null are none; of several targets of one source the one of largest share holds."""
    spark = sizes.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null").orderBy("source", "target_share", "max_repeats").collect()}
    listed = sizes.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    rows = listed.groupBy("source", "n_tokens").count().orderBy("source", "n_tokens").toPandas()
    histogram = {s: (g["n_tokens"].to_numpy(), g["count"].to_numpy()) for s, g in rows.groupby("source")}
    plan, report = plan_mixture(histogram, wanted, seed)
    return histogram, plan, report


def shares(spark: SparkSession, report: list[dict]) -> DataFrame:
    columns = [c.split()[0] for c in REPORT.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in report], REPORT)


def measured(selected: DataFrame, report: list[dict]) -> DataFrame:
    """The report of the mixture as it is: ``tokens`` and ``actual_share`` from the ``selected`` rows (of :func:`mixture`), not from the
    plan. A source is ``limited`` if all it has, repeated as often as may be, is in the mixture and less than its target share
    of the tokens of the listed sources."""
    used = selected.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("_used"))
    planned = shares(selected.sparkSession, report).drop("tokens", "limited", "actual_share")
    every = Window.partitionBy()  # one row a source
    out = planned.join(used, F.col("source") == F.col("_s"), "left").withColumn("tokens", F.coalesce("_used", F.lit(0)))
    out = out.withColumn("limited", (F.col("tokens") == F.col("source_tokens") * F.col("max_repeats")) & (F.col("tokens") < F.col("target_share") * F.sum("source_tokens").over(every)))
    return out.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0))).select(*[c.split()[0] for c in REPORT.split(", ")])


def mixture(sizes: DataFrame, histogram: dict, plan: dict, doc_id: str = "doc_id", seed: int = 42, bucket_docs: int = 50_000) -> DataFrame:
    """``sizes`` rows of the listed sources with ``copies`` of at least 1: how often the document is in the mixture.

    Which documents of a length are taken once more is decided by a seeded hash of ``doc_id`` (ties by ``doc_id``). A length
    with many documents is cut into hash ranges of about ``bucket_docs``: ranges below the wanted number are taken whole
    and only one range is ranked, so no length gathers all its documents in one task. Empty texts (no tokens) belong to
    no share and are left out; so are unlisted and unknown sources. Other columns come through; ``copies`` gets a leading
    underscore if the name is taken.
    """
    spark = sizes.sparkSession
    rows = [(s, int(n), plan[s][0], int(x), max(1, int(-(-c // bucket_docs)))) for s, (lengths, counts) in histogram.items() for n, c, x in zip(lengths, counts, plan[s][1])]
    repeats, extra, buckets, h, b, m, before, copies = fresh(sizes, "repeats", "extra", "buckets", "h", "b", "m", "before", "copies")
    table = spark.createDataFrame(rows, f"source string, n_tokens long, {repeats} int, {extra} long, {buckets} int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_PAIRS else table
    docs = sizes.where(F.col("n_tokens") > 0).join(table, ["source", "n_tokens"]).withColumn(h, F.xxhash64(F.lit(seed), doc_id))
    place = ((F.col(h).cast("double") / F.lit(2.0**64) + 0.5) * F.col(buckets)).cast("int")
    docs = docs.withColumn(b, F.least(F.greatest(place, F.lit(0)), F.col(buckets) - 1))
    # Documents in the hash ranges before each range, for the few lengths that have several.
    pieces = docs.where(F.col(buckets) > 1).groupBy("source", "n_tokens", b).agg(F.count(F.lit(1)).alias(m))
    earlier = F.sum(m).over(Window.partitionBy("source", "n_tokens").orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    docs = docs.join(pieces.select("source", "n_tokens", b, earlier.alias(before)), ["source", "n_tokens", b], "left")
    rank = F.coalesce(before, F.lit(0)) + F.row_number().over(Window.partitionBy("source", "n_tokens", b).orderBy(h, doc_id))
    docs = docs.withColumn(copies, F.col(repeats) + (rank <= F.col(extra)).cast("int"))
    return docs.where(F.col(copies) > 0).select(*sizes.columns, copies)
