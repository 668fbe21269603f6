"""Scans, projections and cross-sectional queries over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.columns import finite, month_number
from paneloom.operators import cross, series
from paneloom.plans.base import CHARACTERISTICS, day, ds, filings, market, panel, query, r, rs, with_
from paneloom.sources import table
from paneloom.sources.files import csv_table, footers, profile, schema_table

RANK = "rank() OVER (PARTITION BY {g}, ({x} IS NULL) ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


def rank_sql(x: str, g: str = "eom") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {RANK.format(x=x, g=g)} END"


def scaled_sql(x: str, g: str = "eom") -> str:
    n = f"count({x}) OVER (PARTITION BY {g})"
    return f"coalesce(CASE WHEN {n} > 1 THEN 2.0 * (({rank_sql(x, g)}) - 1) / nullif({n} - 1, 0) - 1 END, 0)"


@query("SELECT permno, strftime(eom, '%Y-%m-%d') AS eom, CASE WHEN isfinite(me) THEN me END AS me, CASE WHEN isfinite(ret) THEN ret END AS ret FROM chars_final_with_names WHERE eom BETWEEN '2020-01-31' AND '2020-12-31'")
def scan_pushdown(spark: SparkSession, folder: str) -> DataFrame:
    """Four columns and one year reach the Parquet scan (read schema and pushed filters); NaN and infinite numbers come out as null."""
    rows = table(spark, folder, "chars_final_with_names", ["permno", "eom", "me", "ret"])
    return rows.where(F.col("eom").between(F.lit("2020-01-31").cast("date"), F.lit("2020-12-31").cast("date"))).withColumns({"eom": day("eom"), "me": finite("me"), "ret": finite("ret")})


@query("""SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'filings_8k', count(*) FROM filings_8k UNION ALL SELECT 'documents', count(*) FROM documents""")
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts; no column is read."""
    names = ("lineitem", "orders", "customer", "filings_8k", "documents")
    counted = [table(spark, folder, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


_TYPE_SQL = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR[]' THEN 'array<string>' ELSE lower(data_type) END"
_DESCRIBED = ("chars_final_with_names", "filings_8k", "filing_scores")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, column_index AS place, column_name AS feature, {_TYPE_SQL} AS type FROM (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS column_index, * FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE {t})))" for t in _DESCRIBED))
def table_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and types of tables, from metadata."""
    made = [schema_table(table(spark, folder, t)).select(F.lit(t).alias("name"), "place", "feature", "type") for t in _DESCRIBED]
    return made[0].unionByName(made[1]).unionByName(made[2])


_RANGED = ("permno", "delivery_id", "eom", "age")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM chars_final_with_names" for c in _RANGED))
def footer_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, nulls and limits of columns, from the files' footers only."""
    rows = footers(spark, f"{folder}/chars_final_with_names.parquet", _RANGED)
    place = lambda c: F.expr(f"coalesce(try_cast({c} as double), cast(unix_date(try_cast({c} as date)) as double))")
    return rows.groupBy("feature").agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"), F.min_by("least", place("least")).alias("least"), F.max_by("greatest", place("greatest")).alias("greatest"))


_COUNTED = ("permno", "gvkey", "gics", "ticker", "me", "ret", "beta_60m", "be_me", "at_be")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM chars_final_with_names" for c in ("permno", "gvkey", "gics", "ticker")))
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls and distinct values of columns in one pass."""
    return profile(table(spark, folder, "chars_final_with_names"), ["permno", "gvkey", "gics", "ticker"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_discount) + 1e-9, 6) AS avg_disc, median(l_quantity) AS med_qty FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where("l_shipdate <= '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), r(F.avg("l_discount")).alias("avg_disc"), F.median("l_quantity").alias("med_qty"))


@query("SELECT strftime(eom, '%Y-%m-%d') AS eom, tb3ms, round(sp500_ret + 1e-9, 6) AS sp500_ret, round(tb3ms / 1200 + 1e-9, 8) AS rf, round(sp500_ret - rf_m + 1e-9, 6) AS excess FROM market_monthly")
def market_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly market table written as CSV, read back with a schema, with derived rate columns."""
    back = csv_table(spark, table(spark, folder, "market_monthly"))
    return back.select(day("eom").alias("eom"), "tb3ms", r("sp500_ret").alias("sp500_ret"), r(F.col("tb3ms") / 1200, 8).alias("rf"), r(F.col("sp500_ret") - F.col("rf_m")).alias("excess"))


@query(with_("""SELECT f.document_id, f.permno, strftime(f.filing_date, '%Y-%m-%d') AS filing_date, p.size_grp, p.gics2 FROM filings f LEFT JOIN panel p ON f.permno = p.permno AND f.eom = p.eom
ORDER BY f.filing_date, f.document_id LIMIT 500""", "filings", "panel"))
def same_month_join(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptive join of filings with the panel row of their month (a report of the first 500), written in SQL."""
    filings(spark, folder).createOrReplaceTempView("loom_filings")
    panel(spark, folder, "size_grp", "gics2").createOrReplaceTempView("loom_panel")
    return spark.sql("""SELECT f.document_id, f.permno, date_format(f.filing_date, 'yyyy-MM-dd') AS filing_date, p.size_grp, p.gics2
        FROM loom_filings f LEFT JOIN loom_panel p ON f.permno = p.permno AND f.eom = p.eom ORDER BY f.filing_date, f.document_id LIMIT 500""")


@query(with_(f"SELECT {ds('eom')} AS eom, permno, coalesce(prc >= 5 AND me >= quantile_cont(me, 0.2) OVER (PARTITION BY eom), false) AS inside FROM panel", "panel"))
def universe_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed bound and a quantile of the month, which is taken over all rows of the month; null gives false."""
    rows = panel(spark, folder, "prc", "me")
    return rows.select(day("eom").alias("eom"), "permno", (F.coalesce(F.col("prc") >= 5, F.lit(False)) & cross.above_group_quantile("me", ["eom"], 0.2)).alias("inside"))


@query(with_(f"SELECT permno, {ds('eom')} AS eom, {ds('last_day(eom + INTERVAL 1 DAY)')} AS target_month, gics2, {rs('ln(me)')} AS log_me, {rs('ret - ret_exc')} AS rate, year(eom) * 12 + month(eom) AS month_number FROM panel", "panel"))
def derived_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Target month, sector prefix with a sentinel, logarithm and differences."""
    rows = panel(spark, folder, "gics2", "me", "ret", "ret_exc")
    return rows.select("permno", day("eom").alias("eom"), day(series.next_month("eom")).alias("target_month"), "gics2", r(F.log("me")).alias("log_me"), r(F.col("ret") - F.col("ret_exc")).alias("rate"), month_number("eom").cast("long").alias("month_number"))


@query(with_(f"SELECT permno, {ds('eom')} AS eom, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS miss_{c}" for c in ("beta_60m", "at_be")) + " FROM panel", "panel"))
def missing_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of columns whose share of nulls up to 2018 exceeds a rate."""
    rows = panel(spark, folder, "me", "beta_60m", "at_be", "age")
    flagged, _ = cross.missing_flags(rows, ["me", "beta_60m", "at_be", "age"], F.col("eom") <= F.lit("2018-12-31").cast("date"), 0.05)
    return flagged.select("permno", day("eom").alias("eom"), *[c for c in flagged.columns if c.startswith("miss_")])


@query(with_(f"SELECT permno, {ds('eom')} AS eom, {rs(scaled_sql('be_me'))} AS rank_scaled, {rs('coalesce((' + rank_sql('be_me') + ') / nullif(count(be_me) OVER (PARTITION BY eom), 0), 0.5)')} AS pct_rank, CAST(floor(({rank_sql('be_me')}) * 10 / (count(be_me) OVER (PARTITION BY eom) + 1)) AS INTEGER) AS decile FROM panel", "panel"))
def rank_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Average ranks mapped to [-1, 1], to (0, 1] and to ten buckets."""
    rows = panel(spark, folder, "be_me")
    return rows.select("permno", day("eom").alias("eom"), r(cross.rank_scale("be_me", ["eom"])).alias("rank_scaled"), r(cross.percent_rank("be_me", ["eom"])).alias("pct_rank"), cross.bucket("be_me", ["eom"], 10).alias("decile"))


@query(with_(f"SELECT permno, {ds('eom')} AS eom, {rank_sql('ret')} AS average_rank, CASE WHEN ret IS NOT NULL THEN count(ret) OVER (PARTITION BY eom) END AS known FROM panel", "panel"))
def rank_any_size(spark: SparkSession, folder: str) -> DataFrame:
    """Average ranks without a window over whole months, for groups of any size."""
    return cross.with_average_rank(panel(spark, folder, "ret"), "ret", ["eom"], "average_rank").select("permno", day("eom").alias("eom"), "average_rank", "known")


@query(with_(f"""long AS (UNPIVOT (SELECT permno, eom, {", ".join(CHARACTERISTICS)} FROM panel) ON {", ".join(CHARACTERISTICS)} INTO NAME feature VALUE value),
every AS (SELECT permno, eom, feature FROM panel, (SELECT DISTINCT feature FROM long)),
filled AS (SELECT e.*, l.value FROM every e LEFT JOIN long l USING (permno, eom, feature))
SELECT permno, {ds('eom')} AS eom, feature, {rs(scaled_sql('value', 'eom, feature'))} AS value FROM filled""", "panel"))
def rank_scale_many(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of several characteristics in long form: two window specifications for all of them."""
    rows = panel(spark, folder, *CHARACTERISTICS)
    return cross.rank_scale_many(rows, ["permno"], ["eom"], CHARACTERISTICS).select("permno", day("eom").alias("eom"), "feature", r("value").alias("value"))


@query(with_(f"""f AS (SELECT permno, eom, coalesce(gp_at, median(gp_at) OVER (PARTITION BY eom)) AS x FROM panel),
d AS (SELECT *, dense_rank() OVER (PARTITION BY eom ORDER BY x) - 1 AS p FROM f),
m AS (SELECT *, max(p) OVER (PARTITION BY eom) AS top FROM d)
SELECT permno, {ds('eom')} AS eom, {rs('CASE WHEN x IS NULL OR top = 0 THEN 0 ELSE p * 2.0 / top - 1 END')} AS scaled FROM m""", "panel"))
def dense_rank_scale(spark: SparkSession, folder: str) -> DataFrame:
    rows = cross.dense_rank_scale(panel(spark, folder, "gp_at"), "gp_at", ["eom"], "scaled")
    return rows.select("permno", day("eom").alias("eom"), r("scaled").alias("scaled"))


@query(with_(f"""SELECT permno, {ds('eom')} AS eom,
  {rs('coalesce(CASE WHEN stddev_samp(ret_12_1) OVER w > 0 THEN (ret_12_1 - avg(ret_12_1) OVER w) / stddev_samp(ret_12_1) OVER w END, 0)')} AS z_sample,
  {rs('coalesce(CASE WHEN stddev_pop(ret_12_1) OVER w > 0 THEN (ret_12_1 - avg(ret_12_1) OVER w) / stddev_pop(ret_12_1) OVER w END, 0)')} AS z_population,
  {rs('ret_12_1 - avg(ret_12_1) OVER (PARTITION BY eom, gics2)')} AS sector_demeaned
FROM panel WINDOW w AS (PARTITION BY eom)""", "panel"))
def zscores(spark: SparkSession, folder: str) -> DataFrame:
    """Both deviations and the distance from the sector's mean."""
    rows = panel(spark, folder, "ret_12_1", "gics2")
    return rows.select("permno", day("eom").alias("eom"), r(cross.zscore("ret_12_1", ["eom"])).alias("z_sample"), r(cross.zscore("ret_12_1", ["eom"], population=True)).alias("z_population"), r(cross.demean("ret_12_1", ["eom", "gics2"])).alias("sector_demeaned"))


@query(with_(f"""q AS (SELECT *, quantile_cont(ret, 0.01) OVER w AS lo, quantile_cont(ret, 0.99) OVER w AS hi FROM panel WINDOW w AS (PARTITION BY eom))
SELECT permno, {ds('eom')} AS eom, {rs('CASE WHEN ret IS NOT NULL THEN greatest(least(ret, hi), lo) END')} AS clipped FROM q""", "panel"))
def winsor_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder, "ret").select("permno", day("eom").alias("eom"), r(cross.winsorize("ret", ["eom"], 0.01)).alias("clipped"))


@query(with_(f"""lagged AS (SELECT *, CASE WHEN lag(eom) OVER w = last_day(eom - INTERVAL 1 MONTH) THEN lag(me) OVER w END AS me_before FROM panel WINDOW w AS (PARTITION BY permno ORDER BY eom)),
q AS (SELECT *, coalesce(me_before, me) AS w, quantile_cont(ret, 0.01) OVER (PARTITION BY eom) AS lo, quantile_cont(ret, 0.99) OVER (PARTITION BY eom) AS hi FROM lagged),
m AS (SELECT eom, sum(ret * w) / sum(CASE WHEN ret IS NOT NULL THEN w END) AS mkt_ret, stddev_samp(CASE WHEN ret IS NOT NULL THEN greatest(least(ret, hi), lo) END) AS disp, avg(ivol_capm_252d) AS ivol FROM q GROUP BY eom)
SELECT {ds('eom')} AS eom, {rs('mkt_ret')} AS mkt_ret, {rs('disp')} AS disp, {rs('ivol')} AS ivol,
  {rs('CASE WHEN count(mkt_ret) OVER t >= 6 THEN product(1 + mkt_ret) OVER t END - 1')} AS mkt_ret12, {rs('CASE WHEN count(mkt_ret) OVER t >= 6 THEN stddev_samp(mkt_ret) OVER t END')} AS mkt_vol12
FROM m WINDOW t AS (ORDER BY eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "panel"))
def market_state(spark: SparkSession, folder: str) -> DataFrame:
    """Value-weighted return, clipped dispersion, mean volatility, and trailing compounded return and deviation by month."""
    return state_frame(spark, folder).select(day("eom").alias("eom"), *[r(c).alias(c) for c in ("mkt_ret", "disp", "ivol", "mkt_ret12", "mkt_vol12")])


def state_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel(spark, folder, "me", "ret", "ivol_capm_252d")
    before = series.shift_exact("me", ["permno"], 1)
    rows = rows.withColumn("w", F.coalesce(before, "me")).withColumn("clipped", cross.winsorize("ret", ["eom"], 0.01))
    by_month = rows.groupBy("eom").agg((F.sum(F.col("ret") * F.col("w")) / F.sum(F.when(F.col("ret").isNotNull(), F.col("w")))).alias("mkt_ret"), F.stddev_samp("clipped").alias("disp"), F.avg("ivol_capm_252d").alias("ivol"))
    return by_month.withColumns({"mkt_ret12": series.trailing_compound("mkt_ret", []), "mkt_vol12": series.trailing_std("mkt_ret", [])})


@query(with_(f"SELECT {ds('eom')} AS eom, {rs('median(ret - ret_exc)', 8)} AS rf_median, count(ret - ret_exc) AS n FROM panel GROUP BY eom", "panel"))
def rf_median(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.col("ret") - F.col("ret_exc")
    return panel(spark, folder, "ret", "ret_exc").groupBy("eom").agg(r(F.median(gap), 8).alias("rf_median"), F.count(gap).alias("n")).withColumn("eom", day("eom"))


@query(with_(f"SELECT size_grp, count(*) AS n, {rs('avg(ret)')} AS mean, {rs('stddev_samp(ret)')} AS sd, " + ", ".join(f"{rs(f'quantile_cont(ret, {q})')} AS q{int(q * 100)}" for q in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM panel WHERE ret IS NOT NULL GROUP BY size_grp", "panel"))
def describe_by_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel(spark, folder, "size_grp", "ret").where("ret is not null")
    return rows.groupBy("size_grp").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ret")).alias("mean"), r(F.stddev_samp("ret")).alias("sd"), *[r(F.percentile("ret", F.lit(q))).alias(f"q{int(q * 100)}") for q in (0.01, 0.25, 0.5, 0.75, 0.99)])


@query(with_(f"""y AS (SELECT unnest(range(2021, 2027)) AS test_year),
s AS (SELECT permno, last_day(eom + INTERVAL 1 DAY) AS t, ret_exc_lead1m IS NOT NULL AS known FROM panel),
x AS (SELECT test_year, CASE WHEN t < make_date(test_year - 2, 1, 1) AND known THEN 'train' WHEN t >= make_date(test_year - 2, 1, 1) AND t < make_date(test_year, 1, 1) THEN 'valid' WHEN t >= make_date(test_year, 1, 1) AND t < make_date(test_year + 1, 1, 1) AND t <= '2026-08-31' THEN 'test' END AS split, t FROM s, y)
SELECT CAST(test_year AS INTEGER) AS test_year, split, count(*) AS n, {ds('min(t)')} AS first_month, {ds('max(t)')} AS last_month FROM x WHERE split IS NOT NULL GROUP BY ALL""", "panel"))
def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Expanding train, 24-month validation and 12-month test sets keyed by the target month; labels matter for training only."""
    from paneloom.operators.models import split_rows

    rows = panel(spark, folder, "ret_exc_lead1m").withColumn("target_month", series.next_month("eom"))
    return split_rows(rows, range(2021, 2027), "ret_exc_lead1m", "2026-08-31").groupBy("test_year", "split").agg(F.count(F.lit(1)).alias("n"), day(F.min("target_month")).alias("first_month"), day(F.max("target_month")).alias("last_month"))


@query(with_(f"""m AS (SELECT DISTINCT eom FROM panel),
h AS (SELECT eom FROM (SELECT eom, dense_rank() OVER (ORDER BY eom DESC) AS k, count(*) OVER () AS n FROM m) WHERE k <= greatest(least(12, n - 1), 1)),
spine AS (SELECT last_day(CAST(unnest(generate_series(DATE '2015-01-01', DATE '2027-03-01', INTERVAL 1 MONTH)) AS DATE)) AS eom)
SELECT {ds('s.eom')} AS eom, h.eom IS NOT NULL AS holdout, m.eom IS NULL AS absent FROM spine s LEFT JOIN h USING (eom) LEFT JOIN m USING (eom)""", "panel"))
def calendar_check(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar spine against the months there are (missing ones by an anti join's complement) and the last twelve held out."""
    months = panel(spark, folder).select("eom").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    held = months.withColumn("k", F.dense_rank().over(Window.orderBy(F.desc("eom")))).withColumn("n", n).where("k <= greatest(least(12, n - 1), 1)").select("eom", F.lit(True).alias("holdout"))
    spine = spark.range(1).select(F.explode(F.expr("sequence(date'2015-01-01', date'2027-03-01', interval 1 month)")).alias("m")).select(F.last_day("m").alias("eom"))
    out = spine.join(held, "eom", "left").join(months.withColumn("there", F.lit(True)), "eom", "left")
    return out.select(day("eom").alias("eom"), F.coalesce("holdout", F.lit(False)).alias("holdout"), F.col("there").isNull().alias("absent"))


@query(with_(f"""x AS (SELECT *, me >= quantile_cont(me, 0.4) OVER (PARTITION BY eom) AND dolvol_126d >= quantile_cont(dolvol_126d, 0.3) OVER (PARTITION BY eom) AS ok FROM panel),
s AS (SELECT *, ret_12_1 - avg(ret_12_1) OVER (PARTITION BY eom, gics2) AS s FROM x),
u AS (SELECT eom, permno, s, 'long' AS leg, row_number() OVER (PARTITION BY eom ORDER BY s DESC, permno) AS k FROM s WHERE s IS NOT NULL
  UNION ALL SELECT eom, permno, s, 'short', row_number() OVER (PARTITION BY eom ORDER BY s, permno) FROM s WHERE s IS NOT NULL AND ok)
SELECT {ds('eom')} AS eom, permno, leg, {rs('s')} AS score FROM u WHERE k <= 15""", "panel"))
def book_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by sector-demeaned signal: the top of all, the bottom of those above two quantiles of the month."""
    rows = panel(spark, folder, "ret_12_1", "gics2", "me", "dolvol_126d")
    rows = rows.withColumn("s", cross.demean("ret_12_1", ["eom", "gics2"])).withColumn("ok", cross.above_group_quantile("me", ["eom"], 0.4) & cross.above_group_quantile("dolvol_126d", ["eom"], 0.3)).where("s is not null")
    w = Window.partitionBy("eom")
    longs = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("s"), "permno"))).withColumn("leg", F.lit("long"))
    shorts = rows.where("ok").withColumn("k", F.row_number().over(w.orderBy("s", "permno"))).withColumn("leg", F.lit("short"))
    return longs.unionByName(shorts).where("k <= 15").select(day("eom").alias("eom"), "permno", "leg", r("s").alias("score"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) + 1e-9, 4) AS squared FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def finite_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors without a null, NaN or infinite component, with their squared norms."""
    from paneloom.operators.geometry import dot, is_finite

    rows = table(spark, folder, "embeddings").where(is_finite("embedding"))
    return rows.select("vec_id", "label", r(dot("embedding", "embedding"), 4).alias("squared"))


@query("SELECT permno, strftime(eom, '%Y-%m-%d') AS eom, count(*) AS n FROM chars_final_with_names GROUP BY permno, eom HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chars_final_with_names", ["permno", "eom"]).groupBy("permno", "eom").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("eom", day("eom"))


@query(with_(f"SELECT {ds('eom')} AS eom, gics2, count(*) AS n, {rs('count(*) / sum(count(*)) OVER (PARTITION BY eom)')} AS share FROM panel GROUP BY eom, gics2", "panel"))
def group_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each group in its month's cross-section, by count."""
    counted = panel(spark, folder, "gics2").groupBy("eom", "gics2").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(day("eom").alias("eom"), "gics2", "n", r(F.col("n") / F.sum("n").over(Window.partitionBy("eom"))).alias("share"))


@query(with_("""a AS (SELECT DISTINCT permno FROM panel WHERE eom < '2018-01-01'), b AS (SELECT DISTINCT permno FROM panel WHERE eom >= '2024-01-01')
SELECT permno, 'both' AS kind FROM (SELECT permno FROM a INTERSECT SELECT permno FROM b) UNION ALL SELECT permno, 'left' FROM (SELECT permno FROM a EXCEPT SELECT permno FROM b)
UNION ALL SELECT permno, 'new' FROM (SELECT permno FROM b EXCEPT SELECT permno FROM a)""", "panel"))
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Intersection and both differences of two sets of securities, as a tagged union."""
    rows = panel(spark, folder)
    a, b = (rows.where(c).select("permno").distinct() for c in ("eom < '2018-01-01'", "eom >= '2024-01-01'"))
    parts = {"both": a.intersect(b), "left": a.subtract(b), "new": b.subtract(a)}
    out = [d.select("permno", F.lit(k).alias("kind")) for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT {ds('max(eom)')} AS last_month, count(*) AS months FROM market_monthly WHERE eom < last_day(DATE '2026-08-15')")
def drop_in_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Months before the one in progress on a given day."""
    return market(spark, folder).where(F.col("month") < F.last_day(F.lit("2026-08-15").cast("date"))).agg(day(F.max("month")).alias("last_month"), F.count(F.lit(1)).alias("months"))
