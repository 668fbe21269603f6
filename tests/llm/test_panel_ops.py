"""Percentiles and top items: brute force, bounds, ties, hot groups, edge cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.llm import percentiles as module
from paneloom.llm.percentiles import merge_summaries, percentiles, summarize
from paneloom.llm.topn import top_n

PROBS = [0.0, 0.1, 0.5, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 30_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 4, n).astype(str)), "x": np.round(rng.normal(0, 3, n), 1), "d": rng.integers(0, 5, n), "prob_": 1})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_exact_over_several_rounds(spark, skewed):
    pdf, df = skewed
    got = percentiles(df, ["g"], "x", PROBS, finish=300, compact_every=2).toPandas()
    want = pdf.groupby("g").x.quantile(PROBS)
    assert len(got) == 25
    for r in got.itertuples():
        assert r.percentile == pytest.approx(want[r.g, r.prob], abs=1e-12) and r.n == (pdf.g == r.g).sum()


def test_summaries_add_up_within_their_bound(spark, skewed):
    pdf, df = skewed
    # Part 4 is brought and then taken away again.
    moves = df.withColumn("s", F.lit(1)).unionByName(df.where("d = 4").withColumn("s", F.lit(-1)))
    merged = merge_summaries(summarize(moves, ["g", "d", "s"], "x", 16), ["d"], ["g"], [0.1, 0.5, 0.9], sign="s").toPandas()
    assert len(merged) == 15
    for r in merged.itertuples():
        v = np.sort(pdf.x[(pdf.g == r.g) & (pdf.d != 4)].to_numpy())
        k = int(np.floor((len(v) - 1) * r.prob))
        first, last = np.searchsorted(v, r.percentile, "left"), np.searchsorted(v, r.percentile, "right") - 1
        assert len(v) == r.n and max(0, first - k, k - last) <= r.rank_error <= r.n / 8


def test_complete_summaries_are_exact(spark, skewed):
    pdf, df = skewed
    small = df.where("g = '1'").limit(60).cache()
    merged = merge_summaries(summarize(small, ["g", "d"], "x", 1000), ["d"], ["g"], [0.5]).first()
    assert merged["rank_error"] == 0 and merged["percentile"] == sorted(r["x"] for r in small.collect())[29]


def test_percentile_edges(spark):
    schema = "g string, x double, gid string, value double"
    data = [("a", None, "", 0.0), ("a", float("nan"), "", 0.0), ("a", float("inf"), "", 0.0), ("b", 2.0, "", 0.0), (None, 1.0, "", 0.0), (None, 3.0, "", 0.0), ("t", 0.0, "", 0.0), ("t", -0.0, "", 0.0), ("t", 0.0, "", 0.0)]
    got = {(r["g"], r["prob"]): (r["n"], r["percentile"]) for r in percentiles(spark.createDataFrame(data, schema), ["g"], "x", [0.5]).collect()}
    assert got == {("b", 0.5): (1, 2.0), (None, 0.5): (2, 2.0), ("t", 0.5): (3, 0.0)}
    assert percentiles(spark.createDataFrame([], schema), ["g"], "x", [0.5]).count() == 0
    assert summarize(spark.createDataFrame([], schema), ["g"], "x").count() == 0
    assert percentiles(spark.createDataFrame(data, schema), [], "x", [1.0]).first()["percentile"] == 3.0
    with pytest.raises(ValueError):
        percentiles(spark.createDataFrame(data, schema).withColumnRenamed("g", "n"), ["n"], "x", [0.5])


def brute(data, n):
    out = {}
    for g, s, i, e in data:
        out.setdefault(g, []).append((s is None or s != s, -(s or 0) if s == s and s is not None else 0, i, str(e)))
    return {g: sorted(v)[:n] for g, v in out.items()}


def test_top_n_against_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([1.0, 2.0, 2.0, None, float("nan"), -3.5]), rng.randrange(50), rng.choice("xy")) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, s double, i int, score_unknown string").repartition(7)
    for n in (1, 20, 5000):
        got = {}
        for r in top_n(df, ["g"], "s", n, ["i"]).collect():
            got.setdefault(r["g"], []).append((r["s"] is None or r["s"] != r["s"], -(r["s"] or 0) if r["s"] is not None and r["s"] == r["s"] else 0, r["i"], r["score_unknown"]))
        assert {g: sorted(v) for g, v in got.items()} == brute(data, n)


def test_top_n_small_batches_smallest_and_edges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i % 2, i // 2, float(i)) for i in range(40)], "g int, h int, s double").repartition(3)
        assert sorted(r["s"] for r in top_n(df, ["g"], "s", 4, largest=False).collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
        assert top_n(df, ["g", "h"], "s", 1).count() == 40 and top_n(df, [], "s", 3).count() == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert top_n(df, ["g"], "s", 0).count() == 0 and top_n(df.limit(0), ["g"], "s", 5).count() == 0
    same = spark.createDataFrame([(1, 1, 2.0)] * 5, "g int, h int, s double")
    assert top_n(same, ["g"], "s", 3).count() == 3
    nan = spark.createDataFrame([(float("nan"), 1.0), (float("nan"), 2.0), (None, 3.0)], "g double, s double")
    assert top_n(nan, ["g"], "s", 1).count() == 2


def test_one_value_left_a_rank_and_smaller_chunks(spark, skewed):
    """Rounds down to the last value, the chunks rewritten after each."""
    pdf, df = skewed
    got = percentiles(df, ["g"], "x", [0.5], finish=1, compact_every=1).toPandas()
    want = pdf.groupby("g").x.median()
    assert len(got) == 5 and all(r.percentile == pytest.approx(want[r.g]) for r in got.itertuples())


def test_values_are_moved_once_and_a_hot_group_has_many_places(spark, skewed, monkeypatch):
    monkeypatch.setattr(module, "BUFFER", 1000)
    pdf, df = skewed
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        chunks, groups = module.chunk_table(df, ["g"], "x")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = {r["gid"]: r["n"] for r in chunks.groupBy("gid").agg(F.countDistinct("slot").alias("n")).collect()}
    assert places['{"g0":"hot"}'] > 8 and groups.agg(F.sum("_n")).first()[0] == len(pdf)
    moved = chunks.join(chunks.sparkSession.createDataFrame([("x", 1)], "slot string, w int").hint("shuffle_hash"), "slot").select("gid", "chunk", "w")
    moved.collect()
    plan = moved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_group_columns_of_any_type_come_back(spark):
    import datetime as dt

    data = [(dt.date(2020, 1, 31), 'a "q" }|0', 1.5, dt.datetime(2020, 1, 1, 1, 2, 3, 456789), 2.0), (None, "", float("nan"), None, 4.0)]
    df = spark.createDataFrame(data, "d date, s string, f double, t timestamp, x double")
    got = {str(r["d"]): r for r in percentiles(df, ["d", "s", "f", "t"], "x", [0.5]).collect()}
    assert (got["2020-01-31"]["s"], got["2020-01-31"]["f"], got["2020-01-31"]["t"], got["2020-01-31"]["percentile"]) == (*data[0][1:4], 2.0)
    assert got["None"]["s"] == "" and got["None"]["f"] != got["None"]["f"] and got["None"]["t"] is None
