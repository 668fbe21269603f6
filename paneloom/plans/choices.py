"""Queries that compare and choose signals, pivot and fill features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.operators import choice, cross, geometry, report, series, stats
from paneloom.operators.scoring import score_texts
from paneloom.plans.base import CHARACTERISTICS, day, ds, filings, market, panel, query, r, rs, scores, with_
from paneloom.plans.cross_section import rank_sql
from paneloom.plans.estimates import _VECTORS, vectors
from paneloom.sources import table

_LONG = f"""x AS (SELECT permno, eom, size_grp, ret_exc_lead1m AS y, {', '.join(CHARACTERISTICS)} FROM panel),
l AS (UNPIVOT x ON {', '.join(CHARACTERISTICS)} INTO NAME feature VALUE f)"""
_IC = """k AS (SELECT feature, {g} eom, {a} AS a, {b} AS b FROM l WHERE y IS NOT NULL),
i AS (SELECT feature, {g} eom, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM k GROUP BY ALL)"""


def ic_sql(*group: str) -> str:
    keys = ", ".join(["feature", *group, "eom"])
    return _IC.format(g="".join(f"{g}, " for g in group), a=rank_sql("f", keys), b=rank_sql("y", keys))


def _ic(spark: SparkSession, folder: str, *group: str) -> DataFrame:
    rows = panel(spark, folder, "ret_exc_lead1m", *group, *choice.guard(CHARACTERISTICS))
    long = cross.unpivot(rows, ["eom", "ret_exc_lead1m", *group], CHARACTERISTICS)
    return stats.monthly_ic(long, "value", "ret_exc_lead1m", ["feature", *group, "eom"])


@query(with_(f"""{_LONG}, {ic_sql()},
m AS (SELECT test_year, feature, avg(ic) AS mean_ic FROM (SELECT i.*, last_day(eom + INTERVAL 1 DAY) AS month FROM i), (SELECT CAST(unnest(range(2021, 2027)) AS INTEGER) AS test_year) WHERE year(month) BETWEEN test_year - 2 AND test_year - 1 AND ic IS NOT NULL GROUP BY ALL)
SELECT test_year, feature, {rs('mean_ic')} AS mean_ic FROM m QUALIFY row_number() OVER (PARTITION BY test_year ORDER BY round(mean_ic, 10) DESC, feature) = 1""", "panel"))
def walk_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The signal of the best rank correlation over the two years before each test year."""
    best = choice.best_by_validation(_ic(spark, folder).withColumn("month", series.next_month("eom")), range(2021, 2027))
    return best.select("test_year", "feature", r("mean_ic").alias("mean_ic"))


@query(with_(f"""{_LONG}, {ic_sql('size_grp')},
t AS (SELECT size_grp, feature, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS t FROM i GROUP BY ALL),
n AS (SELECT *, coalesce(abs(t) > 2, false) AS selected, row_number() OVER (PARTITION BY size_grp ORDER BY coalesce(abs(t) > 2, false) DESC, round(abs(t), 10) DESC NULLS LAST, feature) AS k FROM t)
SELECT size_grp, feature, {rs('t', 4)} AS t, selected FROM n WHERE selected OR k <= 3""", "panel"))
def feature_top_up(spark: SparkSession, folder: str) -> DataFrame:
    """Features of large t-statistic by size group, topped up to three in each group."""
    t = _ic(spark, folder, "size_grp").groupBy("size_grp", "feature").agg(stats.t_stat("ic").alias("t"))
    t = t.withColumn("selected", F.coalesce(F.abs("t") > 2, F.lit(False)))
    return choice.top_up(t, "size_grp", "t", 3).select("size_grp", "feature", r("t", 4).alias("t"), "selected")


_LEGS = "lb AS (SELECT feature, eom, permno, y AS ret, row_number() OVER (PARTITION BY feature, eom ORDER BY f DESC, permno) AS up, row_number() OVER (PARTITION BY feature, eom ORDER BY f, permno) AS down FROM l)"


@query(with_(f"""{_LONG}, {_LEGS},
b AS (SELECT feature, last_day(eom + INTERVAL 1 DAY) AS month, permno, 1 AS side, 0.1 AS weight, ret FROM lb WHERE up <= 10 UNION ALL SELECT feature, last_day(eom + INTERVAL 1 DAY), permno, -1, -0.1, ret FROM lb WHERE down <= 10),
ch AS (SELECT coalesce(a.feature, o.feature) AS feature, coalesce(a.month, last_day(o.month + INTERVAL 1 DAY)) AS month, sum(abs(coalesce(a.weight, 0) - coalesce(o.weight, 0))) AS moved
  FROM b a FULL JOIN b o ON a.feature = o.feature AND a.permno = o.permno AND a.side = o.side AND a.month = last_day(o.month + INTERVAL 1 DAY) GROUP BY 1, 2),
t AS (SELECT feature, month, round(coalesce(sum(weight * coalesce(ret, 0)) FILTER (weight > 0), 0), 12) + round(coalesce(sum(weight * coalesce(ret, 0)) FILTER (weight < 0), 0), 12) AS ls, round(sum(weight), 12) AS net FROM b GROUP BY ALL),
r AS (SELECT feature, month, rf_m, sp500_exret, rf_m + ls + coalesce(net * (rf_pipe - rf_m), 0) AS total, ls + coalesce(net * (rf_pipe - rf_m), 0) - 0.04 / 12 AS active, moved / 4 AS turnover, month = min(month) OVER (PARTITION BY feature) AS first_month
  FROM t JOIN ch USING (feature, month) JOIN (SELECT CAST(eom AS DATE) AS month, rf_m, rf_pipe, sp500_exret FROM market_monthly) USING (month)),
w AS (SELECT *, product(1 + total) OVER (PARTITION BY feature ORDER BY month ROWS UNBOUNDED PRECEDING) AS w FROM r),
d AS (SELECT *, w / greatest(1, max(w) OVER (PARTITION BY feature ORDER BY month ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM w)
SELECT feature, {rs('CASE WHEN stddev_samp(active) >= 1e-8 THEN avg(active) / nullif(stddev_samp(active), 0) * sqrt(12) END', 5)} AS ir, {rs('CASE WHEN stddev_samp(total - rf_m) >= 1e-8 THEN avg(total - rf_m) / nullif(stddev_samp(total - rf_m), 0) * sqrt(12) END', 5)} AS sharpe, {rs('avg(active) * 12', 5)} AS ann_active,
  {rs('regr_slope(total - rf_m, sp500_exret)', 5)} AS beta, {rs('avg(turnover) FILTER (NOT first_month)', 5)} AS turnover, {rs('min(dd)', 5)} AS max_dd FROM d GROUP BY feature""", "panel"))
def ablation_table(spark: SparkSession, folder: str) -> DataFrame:
    """A book for each signal, the ten names of its largest and of its smallest values, accounted month by month; all signals in one plan."""
    rows = panel(spark, folder, "ret_exc_lead1m", *CHARACTERISTICS)
    long = cross.unpivot(rows, ["permno", "eom", "ret_exc_lead1m"], CHARACTERISTICS)
    sided = cross.top_bottom(long, "value", ["feature", "eom"], 10, "permno")
    held = sided.select("feature", series.next_month("eom").alias("month"), "permno", "side", (F.col("side") * F.lit(0.1)).alias("weight"), F.col("ret_exc_lead1m").alias("ret"), F.lit(None).cast("double").alias("beta_60m"))
    out = report.headline(report.ledger(held, market(spark, folder), ("permno", "side"), ["feature"]), ["feature"])
    return out.select("feature", r("ir", 5).alias("ir"), r("sharpe", 5).alias("sharpe"), r("ann_active", 5).alias("ann_active"), r("beta", 5).alias("beta"), r("avg_turnover", 5).alias("turnover"), r("max_dd", 5).alias("max_dd"))


_YEARS = tuple(range(2015, 2027))


@query(with_("SELECT size_grp, " + ", ".join(f"{rs(f'avg(ret) FILTER (year(eom) = {y})')} AS y{y}" for y in _YEARS) + " FROM panel GROUP BY size_grp", "panel"))
def value_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Mean return by size group and year, years as columns."""
    wide = panel(spark, folder, "size_grp", "ret").withColumn("y", F.year("eom")).groupBy("size_grp").pivot("y", list(_YEARS)).agg(F.avg("ret"))
    return wide.select("size_grp", *[r(F.col(str(y))).alias(f"y{y}") for y in _YEARS])


@query(with_(f"SELECT p.permno, {ds('p.eom')} AS eom, {rs('CASE WHEN f.permno IS NOT NULL THEN ret_12_1 END')} AS filer_signal FROM panel p LEFT JOIN (SELECT DISTINCT permno, eom FROM filings) f ON p.permno = f.permno AND p.eom = f.eom", "panel", "filings"))
def filer_only(spark: SparkSession, folder: str) -> DataFrame:
    """A signal where the security filed in the month, null elsewhere."""
    filed = filings(spark, folder).select("permno", "eom").distinct().withColumn("filed", F.lit(True))
    rows = panel(spark, folder, "ret_12_1").join(filed, ["permno", "eom"], "left")
    return rows.select("permno", day("eom").alias("eom"), r(F.when(F.col("filed"), F.col("ret_12_1"))).alias("filer_signal"))


@query(f"""WITH {_VECTORS}, n AS (SELECT a.vec_id, last_day(a.d) AS eom, (SELECT 1 - max(list_dot_product(a.e, b.e)) FROM u b WHERE b.entity = a.entity AND b.d < a.d AND b.d >= a.d - INTERVAL 24 MONTH) AS novelty FROM u a),
m AS (SELECT eom, avg(novelty) AS mean, median(novelty) AS middle, count(*) AS n FROM n GROUP BY eom),
p AS (SELECT a.eom, median(b.middle) AS past FROM m a LEFT JOIN m b ON b.eom < a.eom GROUP BY a.eom)
SELECT strftime(m.eom, '%Y-%m-%d') AS eom, n, round(coalesce(mean, past, 0) + 1e-9, 5) AS novelty FROM m JOIN p USING (eom)""")
def novelty_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Mean novelty by month; a month without any takes the median of earlier months only, the first ones 0."""
    rows = vectors(spark, folder)
    new = geometry.novelty(rows, "entity", "d", "e", "vec_id", 24).join(rows.select("vec_id", F.last_day("d").alias("eom")), "vec_id")
    months = new.groupBy("eom").agg(F.avg("novelty").alias("mean"), F.median("novelty").alias("middle"), F.count(F.lit(1)).alias("n"))
    past = F.sort_array(F.collect_list("middle").over(Window.orderBy("eom").rowsBetween(Window.unboundedPreceding, -1)))  # one value a month
    size = F.size(past)
    median = F.when(size > 0, (F.get(past, F.floor((size - 1) / 2).cast("int")) + F.get(past, F.floor(size / 2).cast("int"))) / 2)
    return months.select(day("eom").alias("eom"), "n", r(F.coalesce("mean", median, F.lit(0.0)), 5).alias("novelty"))


#: Words of a plain tone lexicon.
GOOD, BAD = ("gain", "growth", "improve", "strong", "ahead", "record", "success"), ("loss", "decline", "weak", "delay", "default", "lawsuit", "wait")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(" + "|".join(GOOD) + ")')) AS good, len(regexp_extract_all(lower(text), '\\b(" + "|".join(BAD) + ")')) AS bad FROM documents WHERE text IS NOT NULL")
def lexicon_tone(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts of a lexicon, the stand-in for a model's sentiment scores, in the JVM."""
    count = lambda words: F.regexp_count(F.lower("text"), F.lit(r"\b(" + "|".join(words) + ")")).cast("long")
    return table(spark, folder, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", count(GOOD).alias("good"), count(BAD).alias("bad"))


def lexicon_model():
    """A model for :func:`score_texts` that needs no weights: the lexicon's counts as scores of good, bad and neither."""
    import re

    import numpy as np

    patterns = [re.compile(r"\b(?:" + "|".join(words) + ")", re.A) for words in (GOOD, BAD)]
    return lambda texts: np.array([[*[len(p.findall(t.lower())) for p in patterns], 0.0] for t in texts])


_COUNT_SQL = "len(regexp_extract_all(lower(text), '\\b({w})'))"


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN {_COUNT_SQL.format(w='|'.join(GOOD))} END AS g, CASE WHEN regexp_matches(text, '\\S') THEN {_COUNT_SQL.format(w='|'.join(BAD))} END AS b FROM documents),
e AS (SELECT *, greatest(g, b, 0) AS top FROM c)
SELECT doc_id, {rs('exp(g - top) / (exp(g - top) + exp(b - top) + exp(-top))')} AS positive, {rs('exp(b - top) / (exp(g - top) + exp(b - top) + exp(-top))')} AS negative, {rs('exp(-top) / (exp(g - top) + exp(b - top) + exp(-top))')} AS neutral FROM e""")
def scored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of three classes from a model that is handed in; here a lexicon, as no weights can be had offline."""
    out = score_texts(table(spark, folder, "documents", ["doc_id", "text"]), "text", lexicon_model, ["positive", "negative", "neutral"])
    return out.select("doc_id", *[r(c).alias(c) for c in ("positive", "negative", "neutral")])


@query(with_(f"SELECT permno, {ds('eom')} AS eom, n, {rs('tone_mean')} AS tone_mean, {rs('t - lag(t) OVER (PARTITION BY permno ORDER BY eom)')} AS change FROM (SELECT permno, eom, count(*) AS n, avg(tone) AS tone_mean, avg(tone) AS t FROM scores GROUP BY ALL)", "scores"))
def tone_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Mean tone by security and month, and its change against the month with a score before."""
    by = scores(spark, folder).groupBy("permno", "eom").agg(F.count(F.lit(1)).alias("n"), F.avg("tone").alias("t"))
    return by.select("permno", day("eom").alias("eom"), "n", r("t").alias("tone_mean"), r(F.col("t") - F.lag("t").over(Window.partitionBy("permno").orderBy("eom"))).alias("change"))
