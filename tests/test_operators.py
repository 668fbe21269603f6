"""Cases worked out by hand and properties of the panel operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import beta, book, cross, geometry, models, report, series, stats
from paneloom.operators import choice
from paneloom.operators.scoring import embed_texts, score_texts
from paneloom.sources.files import cache_or_compute, footers, read_csv, schema_table, write_chunks, write_json, write_submission
from paneloom.streaming.windows import daily_features, event_stream, run_to_end

END = lambda y, m: (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1))


def column(df, c, *order):
    return [r[c] for r in df.orderBy(*order).collect()]


def test_rank_scale_ties_nulls_and_single(spark):
    data = [(1, "A", 1.0), (2, "A", 2.0), (3, "A", 2.0), (4, "A", 3.0), (5, "A", None), (6, "B", 5.0), (7, "B", 5.0), (8, "B", None), (9, "C", 42.0)]
    df = spark.createDataFrame(data, "i int, eom string, x double")
    assert column(df.withColumn("y", cross.rank_scale("x", ["eom"])), "y", "i") == [-1, 0, 0, 1, 0, 0, 0, 0, 0]
    assert column(df.withColumn("y", cross.percent_rank("x", ["eom"])), "y", "i") == [0.25, 0.625, 0.625, 1, 0.5, 0.75, 0.75, 0.5, 1]
    assert column(df.withColumn("y", cross.zscore("x", ["eom"])), "y", "i")[5:] == [0, 0, 0, 0]
    assert column(cross.rank_scale_many(df, ["i"], ["eom"], ["x"]), "value", "i") == [-1, 0, 0, 1, 0, 0, 0, 0, 0]


def test_average_rank_of_any_size_equals_the_window(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, *map(float, range(40))])) for i in range(3000)], "i int, g string, x double")
    a = df.withColumns({"rank": cross.average_rank("x", ["g"]), "known": F.when(F.col("x").isNotNull(), cross.known_count("x", ["g"]))})
    b = cross.with_average_rank(df.repartition(5), "x", ["g"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert cross.with_average_rank(df.limit(0), "x", ["g"]).count() == 0


def test_ema_starts_anew_after_a_gap(spark):
    data = [(1, END(2020, k), v) for k, v in ((1, -1.0), (2, 1.0), (3, 1.0), (5, 1.0))] + [(2, END(2020, k), v) for k, v in ((1, 1.0), (2, -1.0))]
    df = spark.createDataFrame(data, "p int, eom date, z double")
    assert column(series.ema_gap_reset(df, ["p"], "z", 0.5), "smooth", "p", "eom") == [-1.0, 0.0, 0.5, 1.0, 1.0, 0.0]


def test_wave_and_densify(spark):
    data = [("c0", END(2021, 1), 3), ("c0", END(2021, 2), 1), ("c0", END(2021, 3), 5), ("c1", END(2021, 1), 1), ("c1", END(2021, 3), 2)]
    dense = series.densify_months(spark.createDataFrame(data, "c string, eom date, n long"), ["c"], "eom", "n")
    out = dense.withColumn("z", series.surprise("n", ["c"]))
    assert column(out, "z", "c", "eom") == pytest.approx([3, (1 - 3) / 2, 3 / math.sqrt(3), 1, -1 / math.sqrt(2), (2 - 0.5) / math.sqrt(1.5)])


def test_drawdown_from_the_first_month(spark):
    df = spark.createDataFrame([(END(2020, k), x) for k, x in ((1, 0.1), (2, -0.5), (3, 1.0))], "eom date, r double")
    out = series.with_drawdown(df, "r", [])
    assert column(out, "drawdown", "eom") == pytest.approx([0, -0.5, 0]) and column(out, "wealth", "eom")[-1] == pytest.approx(1.1)


def test_forward_beta_without_noise_and_with_a_gap(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=20).tolist()
    data = [(1, END(2020, k + 1), 1.5 * m[k] + 0.1, m[k]) for k in range(20)] + [(2, END(2020, k + 1), 0.5 * m[k], m[k]) for k in range(20) if k != 9]
    out = series.forward_beta(spark.createDataFrame(data, "p int, eom date, r double, m double"), "p", "r", "m")
    got = {(r["p"], r["eom"]): r["forward_beta"] for r in out.collect()}
    assert all(got[1, END(2020, k + 1)] == pytest.approx(1.5) for k in range(8)) and all(got[1, END(2020, k + 1)] is None for k in range(8, 20))
    assert sum(v is not None for (p, _), v in got.items() if p == 2) == 0


def test_ledger_by_hand(spark):
    month, before = END(2021, 2), END(2021, 1)
    w = [(month, 1, 0.6, 0.05, 1.0), (month, 2, 0.4, -0.02, 1.2), (month, 3, -0.7, 0.01, 0.9), (month, 4, -0.3, None, 1.1)]
    old = [(before, 1, 0.6, 0.0, 1.0), (before, 2, 0.4, 0.0, 1.0), (before, 3, -0.7, 0.0, 1.0), (before, 4, -0.2, 0.0, 1.0), (before, 5, -0.1, 0.0, 1.0)]
    b = spark.createDataFrame(w + old, "month date, permno int, weight double, ret double, beta_60m double")
    market = spark.createDataFrame([(m, 0.002, 0.0035, 0.01, 0.008) for m in (month, before)], "month date, rf_m double, rf_pipe double, sp500_ret double, sp500_exret double")
    out = report.ledger(b, market)
    r = out.where(F.col("month") == month).first()
    assert (r["total_ret"], r["bench_ret"], r["active_ret"], r["total_ret_net"]) == pytest.approx((0.017, 0.002 + 0.04 / 12, 0.015 - 0.04 / 12, 0.0168))
    assert column(out, "first_month", "month") == [True, False] and column(out, "turnover", "month")[0] == pytest.approx(0.5)
    tilted = spark.createDataFrame([(month, 1, 0.7, 0.05, 1.0), (month, 2, 0.4, -0.02, None), (month, 3, -0.6, 0.01, 1.0), (month, 4, -0.3, 0.02, 1.0)], b.schema)
    t = report.ledger(tilted, market).first()
    assert (t["net"], t["ls_ret"], t["total_ret"], t["beta_exante"]) == pytest.approx((0.2, 0.015, 0.0173, -0.2))
    unknown = report.ledger(tilted, market.withColumn("rf_pipe", F.lit(None).cast("double"))).first()
    assert unknown["total_ret"] == pytest.approx(0.017)
    assert (r["long_ret"], r["short_ret"], r["gross"], r["missing_ret_weight"], r["turnover"], r["cost"], r["beta_exante"]) == pytest.approx((0.022, -0.007, 2, 0.3, 0.05, 0.0002, 0.12))


def test_contributions_and_rounding(spark):
    b = spark.createDataFrame([(END(2021, 1), 1, 0.5, 0.02, "AAA"), (END(2021, 2), 1, 0.3, -0.01, " "), (END(2021, 1), 2, -0.5, 0.03, None), (END(2021, 2), 2, -0.3, 0.04, None)], "month date, permno int, weight double, ret double, ticker string")
    out = report.contributions(b, labels=["ticker"]).orderBy("permno").collect()
    assert [(r["contribution"], r["ticker"]) for r in out] == [(pytest.approx(0.007), "AAA"), (pytest.approx(-0.027), None)]
    legs = spark.createDataFrame([(END(2021, 1), i, (1 if i < 70 else -1) / 70) for i in range(140)], "month date, permno int, weight double")
    sums = report.round_legs(legs).groupBy(F.signum("weight")).agg(F.round(F.sum("rounded"), 9)).collect()
    assert sorted(r[1] for r in sums) == [-1.0, 1.0]
    # The largest weight has no room for the rest: the next takes it; a leg without room stays as rounded.
    tight = spark.createDataFrame([(END(2021, 1), 1, 0.4), (END(2021, 1), 2, 0.3333333), (END(2021, 1), 3, 0.2666664), (END(2021, 1), 4, -0.5), (END(2021, 1), 5, -0.4999996)], "month date, permno int, weight double")
    out = report.round_legs(tight, cap=0.4).orderBy("permno").collect()
    assert [r["rounded"] for r in out[:2]] == [0.4, pytest.approx(0.333334, abs=1.01e-6)] and all(abs(r["rounded"]) <= 0.5 for r in out)
    assert sum(r["rounded"] for r in out[:3]) == pytest.approx(1 + sum(r["weight"] for r in out) / 2, abs=5.1e-7)


def test_newey_west_against_matrices(spark):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=60), rng.normal(size=60)
    y = 0.3 + 0.7 * x + e + 0.5 * np.roll(e, 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    z = np.stack([np.ones(60), x], 1)
    inv = np.linalg.inv(z.T @ z)
    w = inv @ z.T @ y
    u = z * (y - z @ w)[:, None]
    meat = u.T @ u + sum((1 - k / 4) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in (1, 2, 3))
    hac = np.sqrt(np.diag(inv @ meat @ inv))
    r = stats.newey_west(df, "x", "y", "i").first()
    assert (r["alpha"], r["beta"], r["alpha_se_hac"], r["beta_se_hac"]) == pytest.approx((*w, *hac))


# A published year of monthly returns (strategy, cash rate, index) and what was published about it.
YEAR = """0.13547534128493033 6.666666666666667e-05 -0.0100962491761923
0.01455370780682379 3.3333333333333335e-05 0.027574537649545
0.06506807794949906 2.4999999999999998e-05 0.0437956073426448
0.06699992118012305 1.6666666666666667e-05 0.053369027112194
0.04769059388369299 1.6666666666666667e-05 0.00698412726992
-0.03428200926747028 3.3333333333333335e-05 0.0233454768955689
0.055540266833601096 4.166666666666667e-05 0.0237543225937211
0.005203670450943452 4.166666666666667e-05 0.0304056508125123
-0.029740483539410955 3.3333333333333335e-05 -0.0465093841750909
0.043323843118126544 4.166666666666667e-05 0.0700612960613442
-0.0023886649831945336 4.166666666666667e-05 -0.006928760290665
0.11888655285941173 4.9999999999999996e-05 0.0448164181071606"""
COMPOUNDED = {"strategy_gross": 0.5880391917395007, "benchmark": 0.04119976798869973, "sp500": 0.28705369259327895}
BETA = (0.5069936736191815, 0.3999874610137898, 1.2675239177102668)


def test_a_published_year_is_reproduced(spark):
    data = [(END(2021, k + 1), *map(float, line.split())) for k, line in enumerate(YEAR.splitlines())]
    rows = spark.createDataFrame(data, "month date, total_ret double, rf_m double, sp500_ret double")
    rows = rows.withColumns({"bench_ret": F.col("rf_m") + 0.04 / 12, "sp500_exret": F.col("sp500_ret") - F.col("rf_m"), "active_ret": F.col("total_ret") - F.col("rf_m") - 0.04 / 12, "beta_exante": F.lit(0.0), "net": F.lit(0.0)})
    got = {r["series"]: r for r in report.performance(rows, series=list(COMPOUNDED)).collect()}
    assert {k: r["cumulative"] for k, r in got.items()} == {k: pytest.approx(v, rel=1e-12) for k, v in COMPOUNDED.items()}
    assert (got["strategy_gross"]["best_month"], got["strategy_gross"]["worst_month"], got["benchmark"]["ir"]) == (END(2021, 1), END(2021, 6), None)
    b = {r["metric"]: r for r in report.neutrality(rows).collect()}
    assert (b["beta_2021"]["value"], b["beta_2021"]["se"], b["beta_2021"]["t_stat"]) == pytest.approx(BETA, rel=1e-9) and b["beta_full_period"]["n_obs"] == 12


def test_performance_edges(spark):
    rows = spark.createDataFrame([(END(2020, 1), 0.1, 0.0, 0.1), (END(2020, 2), -0.5, 0.0, 0.1), (END(2020, 3), 0.1, 0.0, 0.1), (END(2020, 4), None, 0.0, 0.1)], "month date, total_ret double, rf_m double, sp500_ret double")
    r = report.performance(rows.withColumn("active_ret", F.col("total_ret")), series=["strategy_gross"]).first()
    assert (r["n"], r["best_month"], r["max_dd"], r["corr_sp500"]) == (3, END(2020, 1), pytest.approx(-0.5), None)
    assert report.performance(rows.limit(0).withColumn("active_ret", F.lit(0.0)), series=["strategy_gross"]).count() == 0


def test_ic_needs_five_rows_and_variance(spark):
    data = [("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, float(i)) for i in range(6)] + [("c", float(i), 1.0 * i) for i in range(4)] + [("a", None, 1.0)]
    out = {r["g"]: (r["n"], r["ic"]) for r in stats.monthly_ic(spark.createDataFrame(data, "g string, p double, y double"), "p", "y", ["g"]).collect()}
    assert out == {"a": (6, pytest.approx(1.0)), "b": (6, None), "c": (4, None)}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.02, 0.03, 0.9, None]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "feature string, p double")
    assert column(stats.benjamini_hochberg(df, "p", 0.05), "selected", "feature") == [True, True, True, False, False]
    z = spark.createDataFrame([(float(x),) for x in (-3, -0.5, 0, 1.96)], "z double").select("z", stats.normal_cdf_column("z").alias("c")).collect()
    assert all(r["c"] == pytest.approx(float(stats.normal_cdf(r["z"])), abs=1e-7) for r in z)


def test_novelty_by_hand(spark):
    d = dt.date
    data = [("A", 1, d(2020, 1, 31), [1.0, 0.0]), ("B", 1, d(2020, 3, 31), [0.0, 1.0]), ("D", 1, d(2020, 9, 15), [0.6, 0.8]), ("C", 1, d(2020, 10, 31), [1.0, 0.0]), ("E", 2, d(2020, 5, 31), [1.0, 0.0])]
    df = spark.createDataFrame(data, "k string, e int, d date, v array<double>")
    out = {r["k"]: r["novelty"] for r in geometry.novelty(df, "e", "d", "v", "k", 6).collect()}
    assert out == {"A": None, "B": pytest.approx(1.0), "D": pytest.approx(0.2), "C": pytest.approx(0.4), "E": None}


def test_novelty_of_a_hot_entity(spark, monkeypatch):
    """Most vectors belong to one entity and one window: its later side is in many tasks, and all of them see its whole earlier side."""
    monkeypatch.setattr(geometry, "NOVELTY_ROWS", 100)
    rng = np.random.default_rng(9)
    n = 1500
    v = rng.normal(size=(n, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    entity = np.where(rng.random(n) < 0.8, 1, rng.integers(2, 6, n))
    day = [dt.date(2019, 6, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 900, n)]
    df = spark.createDataFrame([(i, int(e), d, x.tolist()) for i, (e, d, x) in enumerate(zip(entity, day, v))] + [(9001, None, dt.date(2020, 1, 1), v[0].tolist()), (9002, 1, None, None)], "k long, e int, d date, v array<double>")
    got = {r["k"]: r["novelty"] for r in geometry.novelty(df, "e", "d", "v", "k", 12).collect()}
    assert len(got) == n + 2 and got[9001] is None and got[9002] is None
    for i in range(0, n, 7):
        y, m = divmod(day[i].year * 12 + day[i].month - 1 - 12, 12)
        since = dt.date(y, m + 1, min(day[i].day, 28 if m == 1 else 31))
        past = [v[i] @ v[j] for j in range(n) if entity[j] == entity[i] and since <= day[j] < day[i]]
        assert got[i] == (pytest.approx(1 - max(past)) if past else None)
    assert geometry.novelty(df.limit(0), "e", "d", "v", "k").count() == 0


def test_average_rank_uses_one_partitioning(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, x double").repartition(3).withColumn("r", cross.average_rank("x", ["g"]))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_nearest_centroid_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 7), (2, None, 7), (3, [2.0, 0.0], 7)], "i int, v array<double>, cluster int")
    out = geometry.nearest_centroid(df, "v", [[1.0, 0.0], [1.0, 0.0], [3.0, 0.0]])
    assert out.columns == ["i", "v", "cluster", "_cluster", "distance"]
    assert [(r["i"], r["_cluster"], r["distance"]) for r in out.orderBy("i").collect()] == [(1, 0, 1.0), (2, None, None), (3, 0, 1.0)]
    assert geometry.nearest_centroid(df.limit(0), "v", [[1.0, 0.0]]).count() == 0


def test_whitening(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    mean, projection = geometry.fit_whitening(df, "v", 3)
    assert np.allclose(np.cov((x - mean) @ projection, rowvar=False), np.eye(3), atol=1e-8)
    w = np.array(column(geometry.whiten(df, "v", mean, projection, "w"), "w", "i"))
    assert np.allclose(np.linalg.norm(w, axis=1), 1)


def test_gram_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, 0.0, -2.0] + 0.5 + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(END(2020, i % 8 + 1), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "target_month date, a double, b double, c double, y double")
    grams = models.month_grams(df, ["a", "b", "c"], "y")
    g = models.total(grams.values())
    w, b = models.ridge(g, 0.0)
    z = np.concatenate([x, np.ones((400, 1))], 1)
    assert len(grams) == 8 and np.allclose([*w, b], np.linalg.lstsq(z, y, rcond=None)[0])
    assert g.sse(w, b) == pytest.approx(((y - x @ w - b) ** 2).sum())
    lasso, b1 = models.elastic_net(g, 0.2)
    residual = y - x @ lasso - b1
    slope = (x - x.mean(0)).T @ residual / 400
    assert lasso[1] == 0 and np.allclose(slope[[0, 2]], 0.2 * np.sign(lasso[[0, 2]]), atol=1e-6) and abs(slope[1]) <= 0.2 + 1e-9
    assert models.stability(grams, 0.2, 10)[1] < 0.2


def test_gate_sums_with_other_states(spark):
    """Sums with raw states, mapped, are those of the design with standardised ones."""
    rng = np.random.default_rng(11)
    z, s, y = rng.normal(size=(200, 2)), rng.normal(3, 2, size=(200, 2)), rng.normal(size=200)
    raw = np.concatenate([z, (z[:, :, None] * s[:, None, :]).reshape(200, 4)], 1)
    mean, sd = s.mean(0), s.std(0)
    want = np.concatenate([z, (z[:, :, None] * ((s - mean) / sd)[:, None, :]).reshape(200, 4)], 1)
    gram = lambda x: models.Gram(200, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)
    got = gram(raw).mapped(models.standardised(2, mean, sd))
    assert np.allclose(got.xx, want.T @ want) and np.allclose(got.xy, want.T @ y) and np.allclose(got.sx, want.sum(0))
    assert list(models.gate_design(["a", "b"], ["s", "t"])) == ["a", "b", "a_x_s", "a_x_t", "b_x_s", "b_x_t"]


def test_models_by_name(spark):
    df = spark.createDataFrame([(1, END(2020, 1), 2.0, 3.0, 0.5), (2, END(2020, 1), None, None, None)], "permno int, eom date, beta_60m double, betabab_1260d double, ivol_capm_252d double")
    assert column(beta.estimate(df, "blume"), "beta", "permno") == pytest.approx([1.67, 1.0])
    assert column(beta.estimate(df, "a15"), "beta", "permno") == pytest.approx([0.31 + 0.56 * 2.2 + 0.25, 0.31 + 0.56 * 1.25 + 0.125])
    c = beta.Calibration({"beta_60m": (0.0, 1.0, -9.0, 9.0, 0.5)}, {"constant": 1.0}, 1.0)
    for name in ("fusion", "kalman"):
        assert column(beta.estimate(df, name, c), "beta", "permno") == pytest.approx([5 / 3, 1.0])
    for name, given in (("other", c), ("fusion", None)):
        with pytest.raises(ValueError):
            beta.estimate(df, name, given)


def test_scores_and_embeddings_of_texts(spark):
    def count_model():
        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], float)

    def token_model():
        def run(texts):
            width = max(len(t.split()) for t in texts)
            mask = np.array([[1] * len(t.split()) + [0] * (width - len(t.split())) for t in texts])
            hidden = np.array([[[len(w), 1.0] for w in t.split()] + [[99.0, 99.0]] * (width - len(t.split())) for t in texts], float).reshape(len(texts), width, 2)
            return hidden, mask

        return run

    data = [(1, "a a b", "x"), (2, None, "x"), (3, "  ", "x"), (4, "b" * 100_000, "x"), (4, "b" * 100_000, "x"), (5, "aa bbbb", None)]
    df = spark.createDataFrame(data, "i int, text string, good string")
    out = score_texts(df, "text", count_model, ["good", "bad"], batch=2)
    assert out.columns == ["i", "good", "_good", "bad"]
    got = sorted(((r["i"], r["_good"], r["bad"]) for r in out.collect()), key=lambda r: r[0])
    e = math.e
    assert got[0] == (1, pytest.approx(e / (e + 1)), pytest.approx(1 / (e + 1))) and got[1] == (2, None, None) and got[2] == (3, None, None) and got[3] == got[4] == (4, 0.0, 1.0)
    vectors = {r["i"]: r["embedding"] for r in embed_texts(df, "text", token_model, batch=2).collect()}
    assert vectors == {1: [1.0, 1.0], 2: None, 3: None, 4: [100_000.0, 1.0], 5: [3.0, 1.0]}
    assert score_texts(df.limit(0), "text", count_model, ["p", "q"]).count() == 0


def test_fusion_and_filter(spark):
    c = beta.Calibration({"a": (0.0, 1.0, -9.0, 9.0, 0.5), "b": (0.0, 1.0, -9.0, 9.0, 1.0)}, {"constant": 1.0}, 1.0, 0.9, 0.1)
    df = spark.createDataFrame([(1, END(2020, 1), None, None), (1, END(2020, 2), 2.0, None), (1, END(2020, 3), 2.0, 3.0), (2, END(2020, 1), 2.0, None)], "permno int, eom date, a double, b double")
    mean, var = beta.fuse(c)
    out = df.select("permno", "eom", mean.alias("m"), var.alias("v"))
    assert column(out, "m", "permno", "eom") == pytest.approx([1, 5 / 3, 2, 5 / 3]) and column(out, "v", "permno", "eom") == pytest.approx([1, 1 / 3, 1 / 4, 1 / 3])
    k = {(r["permno"], r["eom"]): (r["beta"], r["beta_var"]) for r in beta.kalman(df, c).collect()}
    p = 0.81 + 0.1
    gain = p / (p + 0.5)
    assert k[1, END(2020, 1)] == (1.0, 1.0) and k[1, END(2020, 2)] == pytest.approx((1 + gain, (1 - gain) * p)) and k[2, END(2020, 1)] == pytest.approx((5 / 3, 1 / 3))


MONTH = "month date, permno long, signal double, beta double, beta_var double, size_z double, gics2 string, has_filing int, eligible boolean"


@pytest.fixture(scope="module")
def month(spark):
    rng = np.random.default_rng(4)
    n = 600
    data = zip([END(2021, 1)] * n, range(n), rng.normal(size=n).tolist(), (1 + 0.4 * rng.normal(size=n)).tolist(), (0.01 * rng.random(n)).tolist(), rng.normal(size=n).tolist(), rng.choice(list("abcdef"), n).tolist(), rng.integers(0, 2, n).tolist(), (rng.random(n) < 0.7).tolist())
    return spark.createDataFrame(list(data), MONTH)


def test_candidates_by_hand(spark):
    data = [(END(2021, 1), p, s, 1.0, 0.0, 0.0, g, p % 2, e) for p, s, g, e in [(1, 3.0, "a", True), (2, 1.0, "a", True), (3, 9.0, "b", True), (4, 7.0, "b", False), (5, 8.0, "b", None), (6, 8.0, "b", True), (7, None, "a", True)]]
    out = book.candidates(spark.createDataFrame(data + data[:2], MONTH), 2)
    assert {(r["permno"], r["side"], round(r["score"], 9)) for r in out.collect()} == {(1, 1, 1.0), (3, 1, 1.0), (2, -1, -1.0), (6, -1, 0.0)}
    assert {r["share"] for r in out.where("gics2 = 'a'").collect()} == {2 / 6}
    assert book.candidates(spark.createDataFrame([], MONTH), 2).count() == 0


@pytest.mark.parametrize("change", [{}, {"net_cap": 0.1}, {"beta_doubt": 0.5}, {"most_names": 240}])
def test_books_keep_all_rules(spark, month, change):
    s = book.Settings(**{"candidates": 200, "least_names": 100, **change})
    m = book.candidates(month, s.candidates).toPandas()
    w, relax = book.optimise(m, {}, s)
    assert relax == ("cardinality" if "most_names" in change else "") and s.least_names <= len(w) <= s.most_names
    held = spark.createDataFrame(pd.DataFrame({"permno": list(w), "weight": list(w.values())})).join(spark.createDataFrame(m.drop(columns="month")), "permno").withColumn("month", F.lit(END(2021, 1)))
    assert book.violations(held, s, (100, 500)).collect() == []
    assert held.where("weight * side <= 0").count() == 0
    if "beta_doubt" in change:
        x = m.set_index("permno").loc[list(w)]
        v = np.array(list(w.values()))
        assert abs(v @ x["beta"] - s.beta_target) + 0.5 * np.sqrt((v**2 * x["beta_var"]).sum()) <= s.beta_tolerance + 1e-3 or relax


def test_planted_violations_are_found(spark):
    data = [(END(2021, 1), 1, 0.8, 5.0, 3.0, "a", 1, 0.5, 0.0), (END(2021, 1), 1, 0.9, 5.0, 3.0, "a", 1, 0.5, 0.0), (END(2021, 1), 3, -0.1, 0.0, 0.0, None, 0, 0.5, 0.0)]
    held = spark.createDataFrame(data, "month date, permno long, weight double, beta double, size_z double, gics2 string, has_filing int, share double, filer_share double")
    rules = {r["rule"] for r in book.violations(held, book.Settings(), (100, 500)).collect()}
    assert rules == {"repeated", "gross", "net", "cap", "names", "beta", "size", "filer", "sector a", "sector none"}
    assert book.violations(held.limit(0), book.Settings()).count() == 0


def test_months_that_cannot_be_solved_are_marked(spark, month):
    s = book.Settings(candidates=200, cap=0.001)
    out = book.backtest(month, [s]).collect()
    assert out == []
    with pytest.raises(Exception, match="no book for"):
        book.backtest(month, [s], strict=True).collect()
    m = book.candidates(month, 200).toPandas()
    assert book.optimise(m, {7: 0.5}, s) == ({7: 0.5}, "failed")


def test_solver_meets_the_optimality_conditions():
    rng = np.random.default_rng(5)
    n = 30
    signal, old = rng.normal(size=n), np.zeros(n)
    rows = np.array([np.ones(n)])
    w = book.solve(signal, old, rows, np.array([1.0]), np.array([1.0]), np.zeros(n), np.full(n, 0.2), 2.0, 0.0, tolerance=1e-8)
    slope = signal - 4.0 * w
    inside = (w > 1e-6) & (w < 0.2 - 1e-6)
    price = slope[inside].mean()
    assert w.sum() == pytest.approx(1, abs=1e-5) and np.allclose(slope[inside], price, atol=1e-4)
    assert (slope[w <= 1e-6] <= price + 1e-4).all() and (slope[w >= 0.2 - 1e-6] >= price - 1e-4).all()


def test_chunks_resume(spark, tmp_path):
    df, made = spark.range(100).withColumnRenamed("id", "k"), []

    def make(part):
        made.append(1)
        if len(made) == 3:
            raise RuntimeError("lost")
        return part.withColumn("double", F.col("k") * 2)

    with pytest.raises(RuntimeError):
        write_chunks(df, "k", str(tmp_path), 4, make)
    assert write_chunks(df, "k", str(tmp_path), 4, make) == 2 and write_chunks(df, "k", str(tmp_path), 4, make) == 0
    out = spark.read.parquet(str(tmp_path))
    assert out.count() == 100 and out.where("double <> k * 2").count() == 0


def test_chunks_scan_the_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id as k", "'x' as chunk").mapInArrow(count, "k long, chunk string")
    assert write_chunks(df, "k", str(tmp_path / "c"), 8, lambda part: part) == 8
    assert seen.value == 1000
    out = spark.read.parquet(*[str(tmp_path / "c" / f"chunk={i:05d}") for i in range(8)])
    assert out.columns == ["k", "chunk"] and out.select("k").distinct().count() == out.count() == 1000


def test_json_and_footers(spark, tmp_path):
    import json

    write_json(spark, {"b": 1.5, "a": [1, 2]}, f"file://{tmp_path}/deep/p.json")
    assert json.loads((tmp_path / "deep" / "p.json").read_text()) == {"a": [1, 2], "b": 1.5}
    spark.createDataFrame([(1, "b"), (7, None), (None, "a")], "x int, s string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r["feature"]: (r["rows"], r["nulls"], r["least"], r["greatest"]) for r in footers(spark, str(tmp_path / "t"), ["x", "s", "none"]).collect()}
    assert got == {"x": (3, 1, "1", "7"), "s": (3, 1, "a", "b"), "none": (3, None, None, None)}
    assert [tuple(r) for r in schema_table(spark.createDataFrame([], "x int, s array<string>")).collect()] == [(0, "x", "int"), (1, "s", "array<string>")]


def test_equal_means_do_not_depend_on_summation(spark):
    ic = [("b", END(2019, 1), 0.1), ("b", END(2019, 2), 0.2), ("b", END(2019, 3), 0.3), ("a", END(2019, 1), 0.3), ("a", END(2019, 2), 0.2), ("a", END(2019, 3), 0.1)]
    for data in (ic, ic[::-1]):
        best = choice.best_by_validation(spark.createDataFrame(data, "feature string, month date, ic double").coalesce(1), [2020]).first()
        assert best["feature"] == "a"


def test_stream_equals_batch(spark, tiny, tmp_path):
    batch = spark.read.parquet(f"{tiny}/events.parquet")
    source = tmp_path / "in"
    batch.repartition(3).write.parquet(str(source))
    stream = daily_features(event_stream(spark, str(source), batch.schema), "1 day")
    run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    last = batch.agg(F.max("ts")).first()[0].date()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = daily_features(batch).where(F.col("day") < F.lit(last - dt.timedelta(days=1)))
    key = lambda r: (r["user_id"], r["day"], r["n"], round(r["value_mean"], 9))
    assert set(map(key, want.collect())) <= set(map(key, got.collect())) <= set(map(key, daily_features(batch).collect()))


def test_truncation_of_series_operators(spark):
    rng = random.Random(6)
    data = [(p, END(2020, k + 1), rng.gauss(0, 0.1)) for p in range(5) for k in range(40) if rng.random() < 0.9]
    cut = END(2022, 1)

    def run(rows):
        df = spark.createDataFrame(rows, "p int, eom date, r double")
        out = series.ema_gap_reset(df, ["p"], "r").withColumns({"c": series.trailing_compound("r", ["p"]), "s": series.trailing_std("r", ["p"]), "x": cross.rank_scale("r", ["eom"])})
        return sorted((r["p"], r["eom"], *[v if v is None else round(v, 9) for v in (r["smooth"], r["c"], r["s"], r["x"])]) for r in out.where(F.col("eom") <= cut).collect())

    assert run(data) == run([r for r in data if r[1] <= cut])


def test_cache_and_submission(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert cache_or_compute(spark, str(tmp_path), "t", params, make, ["id"]).count() == 3
    assert len(made) == 2
    m = END(2021, 1)
    b = spark.createDataFrame([(m, 1, 0.6), (m, 2, 0.4), (m, 3, -1.0)], "month date, permno int, weight double")
    returns = spark.createDataFrame([(m, 0.01)], "month date, total_ret double")
    write_submission(b, returns, str(tmp_path / "s"), 1.0)
    assert read_csv(spark, str(tmp_path / "s" / "holdings"), b.schema).orderBy("permno").collect() == b.orderBy("permno").collect()
    for bad, cap in ((b, 0.5), (b.unionByName(b), 1.0), (b.where("permno <> 3"), 1.0)):
        with pytest.raises(ValueError):
            write_submission(bad, returns, str(tmp_path / "bad"), cap)
    with pytest.raises(ValueError):
        write_submission(b, returns.limit(0), str(tmp_path / "bad"), 1.0)
    assert not (tmp_path / "bad").exists()


def test_guards_and_choice(spark):
    assert choice.guard(["a"], ["a"]) == ["a"]
    for f, n in ((["ret_exc_lead1m"], []), (["a"], ["b"])):
        with pytest.raises(ValueError):
            choice.guard(f, n)
    ic = [("a", END(y, k), 0.1 if y < 2020 else 9.0) for y in (2018, 2019, 2020) for k in range(1, 13)] + [("b", END(y, k), 0.2) for y in (2018, 2019) for k in range(1, 13)]
    best = choice.best_by_validation(spark.createDataFrame(ic, "feature string, month date, ic double"), [2020]).collect()
    assert [(r["feature"], round(r["mean_ic"], 9)) for r in best] == [("b", 0.2)]  # the later jump of "a" is not seen
