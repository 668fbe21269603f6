"""Queries over filings, scores and event streams: pivots, as-of joins, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.columns import month_number
from paneloom.operators import cross
from paneloom.operators.asof import known_at
from paneloom.operators.features import item_type
from paneloom.plans.base import day, ds, filings, panel, query, r, rs, scores, with_
from paneloom.plans.time_series import _ITEMS, _TYPES
from paneloom.sources import table

ITEM_COLUMNS = {c: "item_" + c.replace(".", "_") for c in _TYPES}


def item_rows(spark: SparkSession, folder: str, codes) -> DataFrame:
    """``permno, eom, code`` of each item label of the given numbers."""
    rows = filings(spark, folder, "items").select("permno", "eom", F.explode("items").alias("label"))
    return rows.withColumn("code", F.substring_index(item_type("label"), "(", 1)).where(F.col("code").isin(list(codes))).drop("label")


def filing_features(spark: SparkSession, folder: str) -> DataFrame:
    """Filing counts, item counts and tone by security and month."""
    base = filings(spark, folder).groupBy("permno", "eom").agg(F.count(F.lit(1)).alias("n_filings"))
    pivot = item_rows(spark, folder, _TYPES).groupBy("permno", "eom").pivot("code", list(_TYPES)).count()
    pivot = pivot.select("permno", "eom", *[F.col(f"`{c}`").alias(n) for c, n in ITEM_COLUMNS.items()])
    tone = scores(spark, folder).groupBy("permno", "eom").agg(F.avg("tone").alias("tone_mean"), F.min("tone").alias("tone_min"), F.max("fb_neg").alias("fb_neg_max"))
    out = base.join(pivot, ["permno", "eom"], "left").join(tone, ["permno", "eom"], "left")
    return out.fillna(0, list(ITEM_COLUMNS.values())).fillna(0.0, ["tone_mean", "tone_min", "fb_neg_max"])


_FEATURES = f"""{_ITEMS},
base AS (SELECT permno, eom, count(*) AS n_filings FROM filings GROUP BY ALL),
piv AS (SELECT permno, eom, {', '.join(f"count(*) FILTER (code = '{c}') AS {n}" for c, n in ITEM_COLUMNS.items())} FROM items GROUP BY ALL),
tone AS (SELECT permno, eom, avg(tone) AS tone_mean, min(tone) AS tone_min, max(fb_neg) AS fb_neg_max FROM scores GROUP BY ALL),
features AS (SELECT b.permno, b.eom, n_filings, {', '.join(f'coalesce({n}, 0) AS {n}' for n in ITEM_COLUMNS.values())}, coalesce(tone_mean, 0) AS tone_mean, coalesce(tone_min, 0) AS tone_min, coalesce(fb_neg_max, 0) AS fb_neg_max
  FROM base b LEFT JOIN piv p ON b.permno = p.permno AND b.eom = p.eom LEFT JOIN tone t ON b.permno = t.permno AND b.eom = t.eom)"""


@query(with_(f"""{_FEATURES} SELECT permno, {ds('eom')} AS eom, n_filings, {', '.join(ITEM_COLUMNS.values())}, {rs('tone_mean')} AS tone_mean, {rs('tone_min')} AS tone_min, {rs('fb_neg_max')} AS fb_neg_max FROM features""", "filings", "scores"))
def event_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = filing_features(spark, folder)
    return rows.select("permno", day("eom").alias("eom"), "n_filings", *ITEM_COLUMNS.values(), *[r(c).alias(c) for c in ("tone_mean", "tone_min", "fb_neg_max")])


@query(with_(f"""{_FEATURES} SELECT p.permno, {ds('p.eom')} AS eom, CASE WHEN n_filings IS NULL THEN 0 ELSE 1 END AS has_filing, coalesce(n_filings, 0) AS n_filings, coalesce(item_5_02, 0) AS item_5_02, {rs('coalesce(tone_mean, 0)')} AS tone_mean
FROM panel p LEFT JOIN features f ON p.permno = f.permno AND p.eom = f.eom""", "panel", "filings", "scores"))
def attach_features(spark: SparkSession, folder: str) -> DataFrame:
    """The panel with the filing features of its month, absent ones zero, and a flag."""
    rows = panel(spark, folder).join(filing_features(spark, folder), ["permno", "eom"], "left")
    return rows.select("permno", day("eom").alias("eom"), F.col("n_filings").isNotNull().cast("int").alias("has_filing"), F.coalesce("n_filings", F.lit(0)).alias("n_filings"), F.coalesce("item_5_02", F.lit(0)).alias("item_5_02"), r(F.coalesce("tone_mean", F.lit(0.0))).alias("tone_mean"))


@query(with_(f"""SELECT f.document_id, f.permno, s.document_id IS NOT NULL AS scored FROM filings f LEFT JOIN (SELECT DISTINCT document_id FROM scores) s USING (document_id)""", "filings", "scores"))
def scored_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings with and without a score: a semi and an anti join."""
    f, s = filings(spark, folder).select("document_id", "permno"), scores(spark, folder).select("document_id").distinct()
    return f.join(s, "document_id", "left_semi").withColumn("scored", F.lit(True)).unionByName(f.join(s, "document_id", "left_anti").withColumn("scored", F.lit(False)))


@query(with_("SELECT document_id, permno, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date FROM filings", "filings"))
def sorted_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """All filings by date, ties by id."""
    rows = filings(spark, folder).orderBy("filing_date", "document_id")
    return rows.select("document_id", "permno", F.date_format("filing_date", "yyyy-MM-dd HH:mm:ss").alias("filing_date"))


_GRID = "grid AS (SELECT DISTINCT permno, eom FROM book)"


@query(with_(f"""{_GRID},
own AS (SELECT g.permno, g.eom, p.ticker FROM grid g LEFT JOIN (SELECT permno, eom, ticker FROM panel WHERE trim(ticker) <> '') p ON p.permno = g.permno AND p.eom <= g.eom
  QUALIFY row_number() OVER (PARTITION BY g.permno, g.eom ORDER BY p.eom DESC NULLS LAST) = 1),
fil AS (SELECT g.permno, g.eom, f.ticker FROM grid g LEFT JOIN (SELECT permno, CAST(filing_date AS DATE) AS d, document_id, ticker FROM filings WHERE trim(ticker) <> '') f ON f.permno = g.permno AND f.d <= g.eom
  QUALIFY row_number() OVER (PARTITION BY g.permno, g.eom ORDER BY f.d DESC NULLS LAST, f.document_id DESC) = 1)
SELECT o.permno, {ds('o.eom')} AS eom, coalesce(o.ticker, f.ticker) AS label, CASE WHEN o.ticker IS NOT NULL THEN 'raw_panel' WHEN f.ticker IS NOT NULL THEN 'filing' ELSE 'UNLABELED' END AS label_source
FROM own o JOIN fil f ON o.permno = f.permno AND o.eom = f.eom""", "book", "filings"))
def asof_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Latest label not after the month: from the labelled panel rows, else from filings, with its source; of several
    filings of a day that of the greatest id."""
    from paneloom.plans.base import book

    grid = book(spark, folder).select("permno", "eom").distinct()
    own = panel(spark, folder, "ticker").where("trim(ticker) <> ''").select("permno", F.col("eom").alias("at"), "ticker")
    fil = filings(spark, folder, "ticker").where("trim(ticker) <> ''").select("permno", F.to_date("filing_date").alias("at"), "document_id", "ticker")
    first = known_at(grid, own, event_entity="permno", event_time="eom", keep=["permno", "eom"], change_entity="permno", available_at="at", rank=["at"], attributes=["ticker"])
    both = known_at(first.select("permno", "eom", F.col("ticker").alias("mine")), fil, event_entity="permno", event_time="eom", keep=["permno", "eom", "mine"], change_entity="permno", available_at="at", rank=["at", "document_id"], attributes=["ticker"])
    source = F.when(F.col("mine").isNotNull(), "raw_panel").when(F.col("ticker").isNotNull(), "filing").otherwise("UNLABELED")
    return both.select("permno", day("eom").alias("eom"), F.coalesce("mine", "ticker").alias("label"), source.alias("label_source"))


@query(with_(f"""ends AS (SELECT permno, max(eom) AS last_eom FROM panel GROUP BY permno),
x AS (SELECT p.permno, p.eom, last_eom, (SELECT max(last_eom) FROM ends) AS stop, f.permno IS NOT NULL AS filed FROM panel p JOIN ends USING (permno) LEFT JOIN (SELECT DISTINCT permno, eom FROM filings) f ON p.permno = f.permno AND p.eom = f.eom),
m AS (SELECT *, (year(stop) - year(last_eom)) * 12 + month(stop) - month(last_eom) AS since, (year(last_eom) - year(eom)) * 12 + month(last_eom) - month(eom) AS before FROM x),
b AS (SELECT CASE WHEN since = 0 THEN 'survivor to panel end' WHEN since < 12 THEN NULL WHEN before = 0 THEN 'last panel row' WHEN before <= 2 THEN '1-2 months before exit' WHEN before <= 5 THEN '3-5 months before exit' WHEN before <= 11 THEN '6-11 months before exit' ELSE '12+ months before exit' END AS bucket, filed FROM m)
SELECT bucket, count(*) AS n, {rs('avg(CASE WHEN filed THEN 1.0 ELSE 0.0 END)')} AS coverage FROM b WHERE bucket IS NOT NULL GROUP BY bucket""", "panel", "filings"))
def coverage_by_exit(spark: SparkSession, folder: str) -> DataFrame:
    """Share of security months with a filing, by months before the security's last row; unclear exits left out."""
    rows = panel(spark, folder)
    last = rows.groupBy("permno").agg(F.max("eom").alias("last_eom"))
    stop = last.agg(F.max("last_eom")).first()[0]
    rows = rows.join(last, "permno").withColumn("stop", F.lit(stop))
    rows = rows.join(filings(spark, folder).select("permno", "eom").distinct().withColumn("filed", F.lit(1.0)), ["permno", "eom"], "left")
    since, before = month_number("stop") - month_number("last_eom"), month_number("last_eom") - month_number("eom")
    label = F.when(since == 0, "survivor to panel end").when(since < 12, F.lit(None)).when(before == 0, "last panel row").when(before <= 2, "1-2 months before exit").when(before <= 5, "3-5 months before exit").when(before <= 11, "6-11 months before exit").otherwise("12+ months before exit")
    return rows.withColumn("bucket", label).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.coalesce("filed", F.lit(0.0)))).alias("coverage"))


@query(with_(f"""p AS (SELECT document_id, max(CASE WHEN max_length = 128 THEN fb_pos - fb_neg END) AS a, max(CASE WHEN max_length <> 128 THEN fb_pos - fb_neg END) AS b FROM filing_scores GROUP BY document_id)
SELECT count(*) AS n, {rs('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)')} AS correlation, {rs('max(abs(a - b))')} AS largest_gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL""", "filings"))
def precision_check(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of two scorings of the same documents."""
    from paneloom.operators.stats import safe_corr

    rows = table(spark, folder, "filing_scores", ["document_id", "max_length", "fb_pos", "fb_neg"])
    tone = F.col("fb_pos") - F.col("fb_neg")
    both = rows.groupBy("document_id").agg(F.max(F.when(F.col("max_length") == 128, tone)).alias("a"), F.max(F.when(F.col("max_length") != 128, tone)).alias("b")).where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), r(safe_corr("a", "b")).alias("correlation"), r(F.max(F.abs(F.col("a") - F.col("b")))).alias("largest_gap"))


@query("""WITH e AS (SELECT user_id, event_type, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS starts FROM e)
SELECT user_id, count(*) AS n, CAST(sum(starts) AS BIGINT) AS sessions, round(sum(value) + 1e-9, 4) AS value, count(DISTINCT event_type) AS types FROM s GROUP BY user_id""")
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by gaps of more than six hours, with totals by user."""
    rows = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")), 1).otherwise(0)
    return rows.withColumn("starts", starts).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("starts").alias("sessions"), r(F.sum("value"), 4).alias("value"), F.countDistinct("event_type").alias("types"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value) + 1e-9, 6) AS value_mean, round(min(value) + 1e-9, 6) AS value_min FROM events GROUP BY ALL""")
def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """Event features by user and day; the streaming form of the same is in ``streaming``."""
    from paneloom.streaming.windows import daily_features

    return daily_features(table(spark, folder, "events")).select("user_id", day("day").alias("day"), "n", r("value_mean").alias("value_mean"), r("value_min").alias("value_min"))


@query(with_(f"SELECT permno, {ds('eom')} AS eom, document_id FROM filings QUALIFY row_number() OVER (PARTITION BY permno, eom ORDER BY filing_date DESC, document_id) = 1", "filings"))
def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """The newest filing of each security and month."""
    return cross.first_per_key(filings(spark, folder), ["permno", "eom"], [F.desc("filing_date"), "document_id"]).select("permno", day("eom").alias("eom"), "document_id")
