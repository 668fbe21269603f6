"""Queries of text cleaning, embedding geometry, slow-quantity estimates, models and optimised books."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.operators import beta, book, cross, geometry, models, series, stats, text
from paneloom.plans import events
from paneloom.plans.base import CHARACTERISTICS, book as plain_book, day, ds, panel, query, r, rs, with_
from paneloom.plans.cross_section import rank_sql, scaled_sql, state_frame
from paneloom.plans.time_series import beta_frame
from paneloom.session import materialize
from paneloom.sources import table

# ---- text


def _name_sql(c: str, rounds: int = 8) -> str:
    x = f"trim({c})"
    for _ in range(rounds):
        x = f"trim(regexp_replace(trim(regexp_replace({x}, '{text.JURISDICTION}', '')), '(?i)(?:[,.]|\\s)+(?:{'|'.join(text.SUFFIXES)})\\.?\\s*$', ''))"
    return x


@query(f"SELECT company_name, {_name_sql('company_name')} AS short_name FROM (SELECT DISTINCT company_name FROM filings_8k WHERE company_name IS NOT NULL)")
def strip_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Company names without legal suffixes."""
    names = table(spark, folder, "filings_8k", ["company_name"]).where("company_name is not null").distinct()
    return names.select("company_name", text.strip_suffix("company_name").alias("short_name"))


_LOOK = "(?i)" + "|".join(text.FORWARD)


@query(f"""SELECT doc_id, regexp_matches(text, '{_LOOK}') OR (regexp_matches(text, '(?i)not be deemed') AND (regexp_matches(text, '(?i)furnished') OR regexp_matches(text, '(?i)\\bfiled\\b'))) AS boilerplate FROM documents WHERE text IS NOT NULL""")
def boilerplate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a disclaimer or a forward-looking notice."""
    return table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", text.is_boilerplate("text").alias("boilerplate"))


@query()
def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Filing texts without cover, tail, boilerplate and names; needs look-behind, which SQL engines lack: tests have fixtures."""
    docs = table(spark, folder, "documents", ["doc_id", "text", "document_id"]).where("document_id is not null")
    names = table(spark, folder, "filings_8k", ["document_id", "company_name", "content_company_name", "ticker"])
    names = cross.first_per_key(names.where("document_id is not null"), ["document_id"], ["company_name", "content_company_name", "ticker"])
    return text.clean_text(docs.join(names, "document_id", "left"), "text", ["company_name", "content_company_name"], "ticker").select("doc_id", "clean")


# ---- geometry: vectors of the embeddings table, an entity of several vectors, one day apart

_VECTORS = "v AS (SELECT vec_id, vec_id % 40 AS entity, DATE '2015-01-31' + CAST(vec_id AS INTEGER) AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),\nu AS (SELECT vec_id, entity, d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(geometry.is_finite("embedding"))
    return rows.select("vec_id", (F.col("vec_id") % 40).alias("entity"), F.date_add(F.lit("2015-01-31").cast("date"), F.col("vec_id").cast("int")).alias("d"), geometry.unit("embedding").alias("e"))


@query(f"""WITH {_VECTORS} SELECT a.vec_id, round((SELECT 1 - max(list_dot_product(a.e, b.e)) FROM u b WHERE b.entity = a.entity AND b.d < a.d AND b.d >= a.d - INTERVAL 24 MONTH) + 1e-9, 5) AS novelty FROM u a""")
def interval_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Distance to the closest earlier vector of the entity within 24 months."""
    return geometry.novelty(vectors(spark, folder), "entity", "d", "e", "vec_id", 24).select("vec_id", r("novelty", 5).alias("novelty"))


@query(f"""WITH {_VECTORS}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, e FROM u WHERE vec_id < 8),
n AS (SELECT u.vec_id, CAST(c.cluster AS INTEGER) AS cluster, list_distance(u.e, c.e) AS distance FROM u, c QUALIFY row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_distance(u.e, c.e), 12), c.cluster) = 1),
s AS (SELECT cluster, median(distance) AS spread FROM n GROUP BY cluster)
SELECT vec_id, cluster, round(distance + 1e-9, 5) AS distance, round(distance / nullif(spread, 0) + 1e-9, 4) AS atypicality FROM n JOIN s USING (cluster)""")
def nearest_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest of eight fixed centroids, and the distance over the cluster's median distance."""
    rows = vectors(spark, folder)
    centroids = [x["e"] for x in rows.where("vec_id < 8").orderBy("vec_id").select("e").collect()]
    near = geometry.nearest_centroid(rows, "e", centroids)
    rows = near.join(geometry.cluster_spread(near, "cluster", "distance"), "cluster")
    return rows.select("vec_id", "cluster", r("distance", 5).alias("distance"), r(F.col("distance") / F.col("spread"), 4).alias("atypicality"))


#: Last day of the vectors that whitening and k-means are fitted on, as in the reference.
FIT_END = "2018-12-31"


@query()
def embedding_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Whitening and k-means fitted on all vectors up to ``FIT_END``, all vectors assigned; month-wise counts and mean distance by cluster."""
    rows = table(spark, folder, "embeddings").where(geometry.is_finite("embedding")).select("vec_id", F.date_add(F.lit("2015-01-31").cast("date"), F.col("vec_id").cast("int")).alias("d"), "embedding")
    known = F.col("d") <= F.lit(FIT_END).cast("date")
    mean, projection = geometry.fit_whitening(rows.where(known), "embedding", 16)
    white = materialize(geometry.whiten(rows, "embedding", mean, projection, "w"), "white")
    centroids = geometry.kmeans(white.where(known), "w", 10)
    near = geometry.nearest_centroid(white, "w", centroids)
    return near.groupBy("cluster", F.last_day("d").alias("eom")).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance"))


# ---- slow quantities


@query(with_(f"""SELECT permno, {ds('eom')} AS eom, {rs('coalesce(beta_60m * 0.67 + 0.33, 1.0)')} AS shrunk,
  {rs(f"0.31 + 0.56 * coalesce(beta_60m * 0.67 + 0.33, 1.25) + 0.25 * coalesce(({rank_sql('ivol_capm_252d')}) / nullif(count(ivol_capm_252d) OVER (PARTITION BY eom), 0), 0.5)")} AS chained FROM panel""", "panel"))
def beta_simple(spark: SparkSession, folder: str) -> DataFrame:
    """A shrunk estimate, and a chain of estimates on a line with the volatility rank."""
    rows = panel(spark, folder, "beta_60m", "ivol_capm_252d").withColumn("other", F.lit(None).cast("double"))
    return rows.select("permno", day("eom").alias("eom"), r(beta.shrunk("beta_60m")).alias("shrunk"), r(beta.chained("other", "beta_60m", "ivol_capm_252d", ["eom"])).alias("chained"))


FIXED = beta.Calibration({"beta_60m": (0.4, 0.6, -1.0, 4.0, 0.2), "at_be": (0.9, 0.02, 1.0, 8.0, 0.5)}, {"constant": 1.0, "ivp": 0.2, "gics2=10": 0.1, "gics2=45": -0.05}, 0.3)


def _cal_sql(c: str) -> str:
    a, b, lo, hi, _ = FIXED.estimators[c]
    return f"(CASE WHEN {c} IS NOT NULL THEN {a} + {b} * greatest(least({c}, {hi}), {lo}) END)"


@query(with_(f"""p AS (SELECT *, coalesce(({rank_sql('ivol_capm_252d')}) / nullif(count(ivol_capm_252d) OVER (PARTITION BY eom), 0), 0.5) AS ivp FROM panel),
m AS (SELECT *, 1.0 + 0.2 * ivp + CASE gics2 WHEN '10' THEN 0.1 WHEN '45' THEN -0.05 ELSE 0 END AS prior, 1 / 0.3 + CASE WHEN beta_60m IS NULL THEN 0 ELSE 1 / 0.2 END + CASE WHEN at_be IS NULL THEN 0 ELSE 1 / 0.5 END AS w FROM p)
SELECT permno, {ds('eom')} AS eom, {rs(f"(prior / 0.3 + coalesce({_cal_sql('beta_60m')} / 0.2, 0) + coalesce({_cal_sql('at_be')} / 0.5, 0)) / w")} AS fused, {rs('1 / w')} AS variance FROM m""", "panel"))
def beta_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Precision-weighted fusion with given calibration constants."""
    rows = panel(spark, folder, "beta_60m", "at_be", "ivol_capm_252d", "gics2").withColumn("ivp", cross.percent_rank("ivol_capm_252d", ["eom"]))
    mean, variance = beta.fuse(FIXED)
    return rows.select("permno", day("eom").alias("eom"), r(mean).alias("fused"), r(variance).alias("variance"))


def _calibrated(spark: SparkSession, folder: str) -> tuple[DataFrame, beta.Calibration]:
    rows = beta_frame(spark, folder, "beta_60m", "me", "age", "at_be", "ivol_capm_252d", "gics2")
    rows = rows.withColumn("trailing", series.rolling_beta("ret", "mkt_ret", ["permno"]))
    rows = materialize(beta.prior_features(rows), "beta")
    return rows, beta.calibrate(rows.where("eom <= '2017-12-31'"), "forward_beta", ["beta_60m", "trailing"])


@query()
def beta_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out accuracy of shrunk, fused and filtered estimates, calibrated on the months up to 2017."""
    rows, c = _calibrated(spark, folder)
    fused, _ = beta.fuse(c)
    later = rows.withColumn("shrunk", beta.shrunk("beta_60m")).withColumn("fused", fused)
    filtered = beta.kalman(rows, c).select("permno", "eom", F.col("beta").alias("filtered"))
    return beta.accuracy(later.join(filtered, ["permno", "eom"]).where("eom > '2018-12-31'"), ["shrunk", "fused", "filtered"], "forward_beta")


@query()
def beta_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows, c = _calibrated(spark, folder)
    return beta.kalman(rows, c).select("permno", day("eom").alias("eom"), r("beta").alias("beta"), r("beta_var").alias("beta_var"))


# ---- models


@query(with_(f"""d AS (SELECT permno, eom, ret_exc_lead1m - avg(ret_exc_lead1m) OVER (PARTITION BY eom) AS y FROM panel),
q AS (SELECT *, quantile_cont(y, 0.01) OVER w AS lo, quantile_cont(y, 0.99) OVER w AS hi FROM d WINDOW w AS (PARTITION BY eom))
SELECT permno, {ds('last_day(eom + INTERVAL 1 DAY)')} AS target_month, {rs('CASE WHEN y IS NOT NULL THEN greatest(least(y, hi), lo) END')} AS target FROM q""", "panel"))
def make_target(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel(spark, folder, "ret_exc_lead1m").withColumn("target_month", series.next_month("eom"))
    return models.with_target(rows, "ret_exc_lead1m").select("permno", day("target_month").alias("target_month"), r("target").alias("target"))


_Z = ("be_me", "gp_at", "ret_12_1")


@query(with_(f"SELECT permno, {ds('eom')} AS eom, {rs('(' + ' + '.join(f'coalesce(CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) END, 0)' for c in _Z) + ') / 3')} AS blended FROM panel WINDOW w AS (PARTITION BY eom)", "panel"))
def equal_blend(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel(spark, folder, *_Z).withColumns({f"z_{c}": cross.zscore(c, ["eom"]) for c in _Z})
    return rows.select("permno", day("eom").alias("eom"), r(models.blend([f"z_{c}" for c in _Z])).alias("blended"))


_PHI = "CASE WHEN {z} < 0 THEN {t} ELSE 1 - {t} END"


@query(with_(f"""x AS (SELECT permno, eom, ret_exc_lead1m AS y, {', '.join(CHARACTERISTICS)} FROM panel),
l AS (UNPIVOT x ON {', '.join(CHARACTERISTICS)} INTO NAME feature VALUE f),
k AS (SELECT feature, eom, {rank_sql('f', 'feature, eom')} AS a, {rank_sql('y', 'feature, eom')} AS b FROM l WHERE y IS NOT NULL),
i AS (SELECT feature, eom, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM k GROUP BY ALL),
t AS (SELECT feature, abs(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)) AS t FROM i GROUP BY feature),
c AS (SELECT *, 1 / (1 + 0.2316419 * t) AS s FROM t),
p AS (SELECT feature, 2 * exp(-t * t / 2) / sqrt(2 * pi()) * s * (0.319381530 + s * (-0.356563782 + s * (1.781477937 + s * (-1.821255978 + s * 1.330274429)))) AS p FROM c),
n AS (SELECT *, row_number() OVER (ORDER BY round(p, 12) NULLS LAST, feature) AS k, count(*) OVER () AS n FROM p)
SELECT feature, {rs('p')} AS p, CAST(k AS INTEGER) AS bh_rank, coalesce(k <= (SELECT max(k) FROM n WHERE p <= k / n * 0.5) AND p IS NOT NULL, false) AS selected FROM n""", "panel"))
def bh_select(spark: SparkSession, folder: str) -> DataFrame:
    """Features by false discovery rate of their information coefficients."""
    rows = panel(spark, folder, "ret_exc_lead1m", *CHARACTERISTICS)
    ic = stats.monthly_ic(cross.unpivot(rows, ["eom", "ret_exc_lead1m"], CHARACTERISTICS), "value", "ret_exc_lead1m", ["feature", "eom"])
    t = ic.groupBy("feature").agg(F.abs(stats.t_stat("ic")).alias("t"))
    p = t.withColumn("p", 2 * (1 - stats.normal_cdf_column("t")))
    return stats.benjamini_hochberg(p, "p", 0.5).select("feature", r("p").alias("p"), "bh_rank", "selected")


def _design(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel(spark, folder, "ret_exc_lead1m", *CHARACTERISTICS).withColumn("target_month", series.next_month("eom"))
    rows = models.with_target(rows, "ret_exc_lead1m")
    scaled = {f"x_{c}": cross.rank_scale(c, ["eom"]) for c in CHARACTERISTICS}
    return materialize(rows.select("permno", "eom", "target_month", "ret_exc_lead1m", "target", *[v.alias(k) for k, v in scaled.items()]), "design")


_X = [f"x_{c}" for c in CHARACTERISTICS]


def _years(grams: dict, year: int) -> tuple[list, list]:
    train = [g for m, g in grams.items() if m < f"{year - 2}-01-01"]
    return train, [g for m, g in grams.items() if f"{year - 2}-01-01" <= m < f"{year}-01-01"]


TEST_YEARS = range(2021, 2027)


@query()
def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-sample rank correlation and explained share by year of linear models tuned on two validation years; all fits from one
    pass of monthly sums, all predictions from one more."""
    rows = _design(spark, folder)
    grams = models.month_grams(rows, _X, "target")
    fits = {}
    for year in TEST_YEARS:
        train, valid = (models.total(g) for g in _years(grams, year))
        for family, alphas in (("ols", [0.0]), ("ridge", [1.0, 10.0, 100.0, 1000.0]), ("lasso", [1e-5, 1e-4, 1e-3]), ("elastic", [1e-5, 1e-4, 1e-3])):
            fits[family, year] = models.tune(train, valid, family, alphas)

    def predicted(family: str) -> Column:
        return F.coalesce(*[F.when(F.col("test_year") == y, models.linear(_X, fits[family, y]["weights"], fits[family, y]["intercept"])) for y in TEST_YEARS])

    families = sorted({f for f, _ in fits})
    test = rows.withColumn("test_year", F.year("target_month")).where(F.col("test_year").isin(list(TEST_YEARS)) & (F.col("target_month") <= F.lit("2026-08-31").cast("date")))
    long = cross.unpivot(test.select("target_month", "test_year", "ret_exc_lead1m", *[predicted(f).alias(f) for f in families]), ["target_month", "test_year", "ret_exc_lead1m"], families, "model", "prediction")
    r2 = long.where("ret_exc_lead1m is not null").groupBy("model", "test_year").agg(stats.oos_r2("prediction", "ret_exc_lead1m").alias("r2"))
    ic = stats.monthly_ic(long, "prediction", "ret_exc_lead1m", ["model", "test_year", "target_month"]).groupBy("model", "test_year").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("months"))
    return r2.join(ic, ["model", "test_year"])


@query()
def gated_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of signals that vary with standardised market states, by month: for each test year a ridge gate fitted, and states
    standardised, on the two years before it. All gates come from one pass of monthly sums."""
    signals, states = ["x_be_me", "x_ret_12_1", "x_gp_at"], ["mkt_vol12", "disp"]
    state = state_frame(spark, folder).select("eom", series.next_month("eom").alias("month"), *states)
    known = [r for r in state.orderBy("month").collect() if all(r[c] is not None for c in states)]  # one row a month
    rows = _design(spark, folder).join(F.broadcast(state.drop("month")), "eom")  # one row per month
    design = models.gate_design(signals, states)
    grams = models.month_grams(rows.select("target_month", "target", *[v.alias(k) for k, v in design.items()]), list(design), "target")
    out = []
    for year in TEST_YEARS:
        valid = {m: g for m, g in grams.items() if f"{year - 2}-01-01" <= m < f"{year}-01-01"}
        past = np.array([[r[c] for c in states] for r in known if year - 2 <= r["month"].year < year], float)
        if len(valid) < 2 or len(past) < 2:
            continue
        mean, sd = past.mean(0), past.std(0, ddof=1)
        t = models.standardised(len(signals), mean, sd)
        w, _ = models.fit_gate({m: g.mapped(t) for m, g in valid.items()})
        for r in known:
            if r["month"].year == year:
                z = (np.array([r[c] for c in states], float) - mean) / np.where(sd > 0, sd, 1.0)
                out.append((str(r["month"]), year, *[float(w[k] + w[len(signals) + k * len(states) :][: len(states)] @ z) for k in range(len(signals))]))
    return spark.createDataFrame(out, "target_month string, test_year int, " + ", ".join(f"{s} double" for s in signals))


_ZS = lambda c: f"coalesce(CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) END, 0)"


@query(with_(f"""z AS (SELECT permno, eom, dolvol_126d, {', '.join(f'{_ZS(c)} AS z_{c}' for c in _Z)}, (coalesce(be_me, 0) + coalesce(gp_at, 0) + coalesce(ret_12_1, 0)) / 3 AS pred_ew_ret FROM panel WINDOW w AS (PARTITION BY eom)),
e AS (SELECT *, (z_be_me + z_gp_at + z_ret_12_1) / 3 AS pred_ew, (z_be_me + z_gp_at) / 2 AS pred_ew_notext FROM z)
SELECT permno, {ds('eom')} AS eom, {rs('pred_ew')} AS pred_ew, {rs('pred_ew_notext')} AS pred_ew_notext, {rs('pred_ew_ret')} AS pred_ew_ret, {rs(f"({_ZS('pred_ew')} + {_ZS('dolvol_126d')}) / 2")} AS pred_blend FROM e WINDOW w AS (PARTITION BY eom)""", "panel"))
def four_blends(spark: SparkSession, folder: str) -> DataFrame:
    """The equal-weight blends over three characteristics as specialists, the last as the text one, and a fourth as the tree model."""
    rows = models.blends(panel(spark, folder, *_Z, "dolvol_126d"), _Z, ["ret_12_1"], _Z, "dolvol_126d")
    return rows.select("permno", day("eom").alias("eom"), *[r(c).alias(c) for c in ("pred_ew", "pred_ew_notext", "pred_ew_ret", "pred_blend")])


_IVP = f"coalesce(({rank_sql('ivol_capm_252d')}) / nullif(count(ivol_capm_252d) OVER (PARTITION BY eom), 0), 0.5)"


@query(with_(f"""p AS (SELECT *, {_IVP} AS ivp FROM panel),
f AS (SELECT *, 1.0 + 0.2 * ivp + CASE gics2 WHEN '10' THEN 0.1 WHEN '45' THEN -0.05 ELSE 0 END AS prior, 1 / 0.3 + CASE WHEN beta_60m IS NULL THEN 0 ELSE 1 / 0.2 END + CASE WHEN at_be IS NULL THEN 0 ELSE 1 / 0.5 END AS w FROM p),
m AS (SELECT 'blume' AS model, permno, eom, coalesce(beta_60m * 0.67 + 0.33, 1.0) AS beta, 0.0 AS beta_var FROM f
  UNION ALL SELECT 'a15', permno, eom, 0.31 + 0.56 * coalesce(CASE WHEN at_be IS NOT NULL THEN greatest(least(at_be, 4.0), -1.0) END * 0.6 + 0.4, beta_60m * 0.67 + 0.33, 1.25) + 0.25 * ivp, 0.0 FROM f
  UNION ALL SELECT 'fusion', permno, eom, (prior / 0.3 + coalesce({_cal_sql('beta_60m')} / 0.2, 0) + coalesce({_cal_sql('at_be')} / 0.5, 0)) / w, 1 / w FROM f)
SELECT model, permno, {ds('eom')} AS eom, {rs('beta')} AS beta, {rs('CAST(beta_var AS DOUBLE)')} AS beta_var FROM m""", "panel"))
def beta_models(spark: SparkSession, folder: str) -> DataFrame:
    """Three models by name; ``at_be`` stands in for the first estimator of the chain, which the tables lack."""
    rows = panel(spark, folder, "beta_60m", "at_be", "ivol_capm_252d", "gics2").withColumn("ivp", cross.percent_rank("ivol_capm_252d", ["eom"]))
    made = [beta.estimate(rows, m, FIXED, first="at_be").select(F.lit(m).alias("model"), "permno", day("eom").alias("eom"), r("beta").alias("beta"), r("beta_var").alias("beta_var")) for m in ("blume", "a15", "fusion")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query()
def stability_selection(spark: SparkSession, folder: str) -> DataFrame:
    """How often the lasso keeps each feature over random halves of the months up to 2018."""
    grams = {m: g for m, g in models.month_grams(_design(spark, folder), _X, "target").items() if m < "2019-01-01"}
    kept = models.stability(grams, 3e-4)
    return spark.createDataFrame([(c, float(k)) for c, k in zip(_X, kept)], "feature string, kept double")


@query()
def boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees trained before 2019; rank correlation by month after 2020."""
    rows = _design(spark, folder)
    model = models.boosted_trees(rows.where("target_month < '2019-01-01' and target is not null"), _X, "target")
    from pyspark.ml.feature import VectorAssembler

    later = VectorAssembler(inputCols=_X, outputCol="features").transform(rows.where("target_month >= '2021-01-01'"))
    return stats.monthly_ic(model.transform(later), "prediction", "ret_exc_lead1m", ["target_month"]).withColumn("target_month", day("target_month"))


# ---- books


def _candidates(spark: SparkSession, folder: str, first: str = "2020-12-01") -> DataFrame:
    rows = panel(spark, folder, "ret_12_1", "beta_60m", "me", "gics2", "dolvol_126d").where(F.col("eom") >= F.lit(first).cast("date"))
    filed = events.filing_features(spark, folder).select("permno", "eom", F.lit(1).alias("has_filing"))
    rows = rows.join(filed, ["permno", "eom"], "left").withColumn("log_me", F.log("me"))
    eligible = cross.above_group_quantile("me", ["eom"], 0.4) & cross.above_group_quantile("dolvol_126d", ["eom"], 0.3)
    return rows.select(series.next_month("eom").alias("month"), "permno", cross.zscore("ret_12_1", ["eom"], population=True).alias("signal"), F.coalesce("beta_60m", F.lit(1.0)).alias("beta"), F.lit(0.0).alias("beta_var"), cross.zscore("log_me", ["eom"]).alias("size_z"), "gics2", F.coalesce("has_filing", F.lit(0)).alias("has_filing"), eligible.alias("eligible"))


#: Wide bounds, as the test tables have few names a month.
LOOSE = book.Settings(l2=5.0, turnover=0.5, cap=0.25, sector_tolerance=0.5, size_tolerance=1.0, beta_tolerance=0.5)


@query()
def optimised_book(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of a constrained book, month after month."""
    return book.backtest(_candidates(spark, folder), [LOOSE]).select(day("month").alias("month"), "permno", r("weight").alias("weight"), "relax")


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """The plain book with the columns that its rules are checked on; a sector's share is that among the month's names."""
    rows = plain_book(spark, folder).withColumn("log_me", F.log("me"))
    by, sector = Window.partitionBy("month"), Window.partitionBy("month", "gics2")
    share = F.count(F.lit(1)).over(sector) / F.count(F.lit(1)).over(by)
    return rows.select("month", "permno", "weight", F.col("beta_60m").alias("beta"), cross.zscore("log_me", ["month"]).alias("size_z"), "gics2", F.lit(0).alias("has_filing"), share.alias("share"), F.lit(0.0).alias("filer_share"))


#: Rules that the plain book breaks in some months and keeps in others.
STRICT = book.Settings(cap=0.1, sector_tolerance=0.15, size_tolerance=2.0, beta_tolerance=2.0, net_cap=0.05)


@query(with_(f"""h AS (SELECT month, permno, weight, coalesce(beta_60m, 0) AS beta, coalesce(CASE WHEN stddev_samp(ln(me)) OVER m > 0 THEN (ln(me) - avg(ln(me)) OVER m) / stddev_samp(ln(me)) OVER m END, 0) AS z, gics2,
  count(*) OVER (PARTITION BY month, gics2) / count(*) OVER m AS share FROM book WINDOW m AS (PARTITION BY month)),
b AS (SELECT month, count(*) - count(DISTINCT permno) AS repeated, abs(sum(abs(weight)) - 2) AS gross, greatest(abs(sum(weight)) - {STRICT.net_cap}, 0) AS net, greatest(max(abs(weight)) - {STRICT.cap}, 0) AS cap, greatest({15} - count(*), count(*) - {19}, 0) AS names,
  greatest(abs(sum(weight * beta) - {STRICT.beta_target} * sum(CASE WHEN weight > 0 THEN weight ELSE 0 END)) - {STRICT.beta_tolerance}, 0) AS beta, greatest(abs(sum(weight * z)) - {STRICT.size_tolerance}, 0) AS size, sum(weight) AS n FROM h GROUP BY month),
r AS (SELECT month, unnest(['repeated', 'gross', 'net', 'cap', 'names', 'beta', 'size']) AS rule, unnest([CAST(repeated AS DOUBLE), gross, net, cap, names, beta, size]) AS value, unnest([0.5, 1e-4, 1e-4, 1e-9, 0.5, 1e-4, 1e-4]) AS bound FROM b),
s AS (SELECT h.month, 'sector ' || gics2 AS rule, greatest(abs(sum(weight) - any_value(n) * max(share)) - {STRICT.sector_tolerance}, 0) AS value FROM h JOIN b USING (month) GROUP BY h.month, gics2)
SELECT {ds('month')} AS month, rule, {rs('value', 5)} AS value FROM r WHERE value > bound UNION ALL SELECT {ds('month')}, rule, {rs('value', 5)} FROM s WHERE value > 1e-4""", "book"))
def book_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What the plain book breaks of strict rules, by month and rule; 15 to 19 names are wanted."""
    out = book.violations(_held(spark, folder), STRICT, (15, 19))
    return out.select(day("month").alias("month"), "rule", r("value", 5).alias("value"))


@query()
def calibration_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Names and turnover of the books of the reference's grid of penalties over the 24 validation months 2019-2020, with the
    reference's number of candidates, and the distance from wanted ones."""
    settings = book.grid(LOOSE, [100.0, 300.0, 1000.0, 3000.0], [0.1, 0.3, 1.0, 3.0])
    months = _candidates(spark, folder, "2018-12-01").where("month >= '2019-01-01' and month < '2021-01-01'")
    made = materialize(book.backtest(months, settings), "books")
    return book.shape_score(made, 15, 0.3)
