"""Queries p2 to p5: the general training-data problems over the security panel and the filings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.columns import clean_text, finite
from paneloom.operators.asof import known_at
from paneloom.operators.features import as_of_features, cumulative_store, daily_totals, item_type, wide_features
from paneloom.operators.impute import fill_missing, fit_tree
from paneloom.operators.history import fill_from_neighbours, latest_delivery, snapshot_changes, version_history
from paneloom.session import materialize
from paneloom.sources import table

SPAN = ("2015-01-01", "2026-09-01")
TOTALS = ("text_chars", "word_count")


def in_span(time: str = "filing_date") -> Column:
    """Bounds of the column's own type, so that they reach the scan."""
    return (F.col(time) >= F.lit(SPAN[0]).cast("timestamp_ntz")) & (F.col(time) < F.lit(SPAN[1]).cast("timestamp_ntz"))


#: The number of items of each section of the form, numbered 1.01, 1.02 and so on, and their paragraph letters.
FORM_ITEMS = {1: 5, 2: 6, 3: 3, 4: 2, 5: 8, 6: 6, 7: 1, 8: 1, 9: 1}
PARAGRAPHS = "abcdefgh"
ITEM_TYPES = [f"{section}.{item:02d}{letter}" for section, n in FORM_ITEMS.items() for item in range(1, n + 1) for letter in ("", *[f"({p})" for p in PARAGRAPHS])]


def filing_store(spark: SparkSession, folder: str, totals: Sequence[str] = TOTALS) -> DataFrame:
    """Cumulative counts and totals of all dated filings by security, item type and day."""
    filings = table(spark, folder, "filings_8k", ["document_id", "permno", "filing_date", "items", *totals])
    filings = filings.withColumn("types", F.filter(F.transform("items", item_type), lambda t: t.isNotNull()))
    return cumulative_store(daily_totals(filings, "permno", "types", "filing_date", "document_id", totals), totals)


def span_features(store: DataFrame, end: str, totals: Sequence[str], windows: dict[str, int] | None = None) -> DataFrame:
    """Features of the filings from the beginning of the span to ``end``: a window like any other, the difference of the store's
    two endpoints, so that days with impossible dates before the span drop out of it. Security and type need a filing in the window; the
    newest one up to ``end`` is then in it too."""
    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(SPAN[0])).days + 1
    features = as_of_features(store, end, totals, {"span": days, **(windows or {})}).where("n_span > 0")
    return features.drop("n", *totals).withColumnsRenamed({f"{c}_span": c for c in ("n", *totals)})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    features = span_features(filing_store(spark, folder, ()), "2026-08-31", ())
    return features.select(F.col("entity").alias("permno"), "event_type", F.col("newest_id").alias("document_id"))


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per security, the same columns on any data: those of all items and paragraphs of the form."""
    features = span_features(filing_store(spark, folder), "2026-08-31", TOTALS, {"365d": 365})
    features = features.withColumn("newest", F.to_date("newest"))
    return wide_features(features, WIDE, [c for c in WIDE if c != "newest"], ITEM_TYPES).withColumnRenamed("entity", "permno")


WIDE = ("n", "newest", *TOTALS, "n_365d")


def p2_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The long form at an earlier date, with features of the last 30 and 365 days."""
    features = span_features(filing_store(spark, folder), "2022-06-30", TOTALS, {"30d": 30, "365d": 365})
    return features.withColumn("newest", F.date_format("newest", "yyyy-MM-dd")).withColumnRenamed("entity", "permno")


PANEL_ATTRIBUTES = ("gvkey", "iid", "gics", "size_grp", "me", "prc", "loaded_at")


def _known(spark: SparkSession, folder: str, attributes: tuple[str, ...]) -> DataFrame:
    filings = table(spark, folder, "filings_8k", ["document_id", "permno", "filing_date"]).where(in_span() & F.col("permno").isNotNull())
    panel = table(spark, folder, "chars_final_with_names", list(dict.fromkeys(["permno", "loaded_at", "eom", "delivery_id", *attributes])))
    panel = panel.withColumns({c: finite(c) for c in ("me", "prc") if c in attributes})
    return known_at(
        filings, panel, event_entity="permno", event_time="filing_date", keep=["document_id", "permno", "filing_date"], change_entity="permno",
        available_at="loaded_at", rank=["eom", "delivery_id"], attributes=attributes, drop_unmatched=not attributes,
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder, ()).select("document_id", F.date_format("eom", "yyyy-MM-dd").alias("eom"), "delivery_id")


def p3_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every filing in span with the panel attributes known at its date; nulls where nothing was known and for numbers that are NaN
    or infinite."""
    known = _known(spark, folder, PANEL_ATTRIBUTES)
    shown = {"filing_date": F.date_format("filing_date", "yyyy-MM-dd HH:mm:ss"), "loaded_at": F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss"), "eom": F.date_format("eom", "yyyy-MM-dd")}
    return known.select(*[shown[c].alias(c) if c in shown else c for c in known.columns])


def security_identifiers(panel: DataFrame) -> DataFrame:
    """``gvkey`` in six digits, ``iid`` and ``ticker`` (upper case, dot before the class letter) without blanks."""
    gvkey, ticker = clean_text("gvkey"), F.upper(clean_text("ticker"))
    return panel.select(
        "permno", "eom", "delivery_id", F.when(F.length(gvkey) < 6, F.lpad(gvkey, 6, "0")).otherwise(gvkey).alias("gvkey"),
        clean_text("iid").alias("iid"), F.regexp_replace(ticker, r"[\s./\-]+([A-Z])$", r".$1").alias("ticker"),
    )


IDENTIFIERS = ("gvkey", "iid", "ticker")


def identifier_changes(spark: SparkSession, folder: str) -> DataFrame:
    panel = security_identifiers(table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", *IDENTIFIERS]))
    final = latest_delivery(panel.where(F.col("permno").isNotNull()), ["permno", "eom"], "delivery_id", IDENTIFIERS)
    return snapshot_changes(fill_from_neighbours(final, "permno", "eom", IDENTIFIERS), "permno", "eom", IDENTIFIERS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    versions = version_history(identifier_changes(spark, folder), "permno", IDENTIFIERS)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return versions.select("permno", day("valid_from"), day("valid_to"), *IDENTIFIERS)


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The insertions, changes and deletions between neighbouring snapshots."""
    changes = identifier_changes(spark, folder)
    return changes.select("permno", F.date_format("at", "yyyy-MM-dd").alias("at"), F.date_format("seen", "yyyy-MM-dd").alias("seen"), "kind", *IDENTIFIERS)


#: Fields of the dependency tree over the panel; numeric ones with their number of bins.
TREE_NUMERIC = {"beta_60m": 24, "own_beta": 24, "ivol_capm_252d": 8, "dolvol_126d": 8, "age": 8}
TREE_CATEGORICAL = ("gics", "own_gics", "size_grp", "year")


def panel_with_context(panel: DataFrame, codes: DataFrame) -> DataFrame:
    """Panel rows with usable ``beta_60m`` and ``gics`` (else null) and what the security's other rows say: ``own_beta``,
    the mean of the usable betas of its nearest year that has some (the row's own left out), and ``own_gics``, that year's
    most frequent code. Only one row per security and year is windowed, so a hot security costs no more than its years."""
    beta = F.when(F.abs(finite("beta_60m")) <= 10, F.col("beta_60m"))
    valid = F.broadcast(codes.select(F.col("gics").alias("code")).distinct())  # a fixed table: the valid codes of the classification
    rows = panel.withColumn("beta_60m", beta).withColumn("code_asked", F.trim("gics")).join(valid, F.col("code_asked") == F.col("code"), "left")
    rows = rows.withColumn("gics", F.col("code")).withColumn("year", F.year("eom")).drop("code", "code_asked")

    by_code = rows.groupBy("permno", "year", "gics").agg(F.count(F.lit(1)).alias("n"), F.sum("beta_60m").alias("total"), F.count("beta_60m").alias("betas"))
    mode = F.max(F.when(F.col("gics").isNotNull(), F.struct("n", "gics")))["gics"]
    yearly = by_code.groupBy("permno", "year").agg(F.sum("total").alias("total"), F.sum("betas").alias("betas"), mode.alias("mode"))
    w = Window.partitionBy("permno").orderBy("year")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    mean = F.when(F.col("betas") > 0, F.col("total") / F.col("betas"))
    near = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))
    yearly = yearly.withColumn("mean", mean).select(F.col("permno").alias("p"), F.col("year").alias("y"), "total", "betas", "mode", near("mean").alias("near_beta"), near("mode").alias("near_gics"))
    out = rows.join(yearly, F.col("permno").eqNullSafe(F.col("p")) & F.col("year").eqNullSafe(F.col("y")), "left")
    others = F.col("betas") - F.col("beta_60m").isNotNull().cast("int")
    own = F.when(others > 0, (F.col("total") - F.coalesce("beta_60m", F.lit(0.0))) / others)
    return out.select(*rows.columns, F.coalesce(own, "near_beta").alias("own_beta"), F.coalesce("mode", "near_gics").alias("own_gics"))


def p4_fill(spark: SparkSession, folder: str) -> DataFrame:
    """All delivered rows, each once, with filled ``beta_60m`` and ``gics`` and marks on the filled cells."""
    panel = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", "beta_60m", "gics", "ivol_capm_252d", "dolvol_126d", "age", "size_grp"])
    rows = materialize(panel_with_context(panel, table(spark, folder, "gics_codes")), "panel")
    tree = fit_tree(rows, TREE_NUMERIC, TREE_CATEGORICAL)
    filled = fill_missing(rows.select("permno", "eom", "delivery_id", *TREE_NUMERIC, *TREE_CATEGORICAL), tree, ["beta_60m", "gics"])
    return filled.select("permno", "eom", "delivery_id", "beta_60m", "gics", "beta_60m_filled", "gics_filled").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    filled = p4_fill(spark, folder)
    names = F.array(*[F.when(F.col(f"{c}_filled"), F.lit(c)) for c in ("beta_60m", "gics")])
    cells = filled.select("permno", F.date_format("eom", "yyyy-MM-dd").alias("eom"), "delivery_id", F.explode(names).alias("field_name"))
    return cells.where(F.col("field_name").isNotNull()).distinct()


def p4_known(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of :func:`p4_fill` with their marks, filled values taken out again: what was known must come through as it was."""
    filled = p4_fill(spark, folder)
    kept = {c: F.when(~F.col(f"{c}_filled"), F.col(c)).alias(c) for c in ("beta_60m", "gics")}
    return filled.select("permno", F.date_format("eom", "yyyy-MM-dd").alias("eom"), "delivery_id", *kept.values(), "beta_60m_filled", "gics_filled").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_features, p2_windows, p3_found, p3_attributes, p4_found, p4_fill, p4_known, p5_found, p5_changes)}

_TYPED = r"""
typed AS (
  SELECT DISTINCT permno, document_id, filing_date, text_chars, word_count,
    regexp_extract(lower(label), '(\d{1,2}\.\d{2})', 1)
      || CASE WHEN regexp_extract(lower(label), '\d{1,2}\.\d{2}[\s\-(]*([a-z])([^a-z0-9]|$)', 1) = '' THEN ''
              ELSE '(' || regexp_extract(lower(label), '\d{1,2}\.\d{2}[\s\-(]*([a-z])([^a-z0-9]|$)', 1) || ')' END AS event_type
  FROM (SELECT permno, document_id, filing_date, text_chars, word_count, unnest(items) AS label FROM filings_8k
        WHERE filing_date >= '2015-01-01' AND filing_date < '2026-09-01' AND permno IS NOT NULL)
  WHERE regexp_matches(label, '\d{1,2}\.\d{2}')
)"""

_FEATURES = """
SELECT permno, event_type, count(*) AS n, CAST(coalesce(sum(text_chars), 0) AS BIGINT) AS text_chars, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS word_count,
  strftime(max(filing_date), '%Y-%m-%d') AS newest, arg_min(document_id, (-epoch_us(filing_date), document_id)) AS newest_id
"""

_FINAL = """
clean AS (
  SELECT permno, eom, delivery_id, lpad(nullif(trim(gvkey), ''), 6, '0') AS gvkey, nullif(trim(iid), '') AS iid,
    regexp_replace(upper(nullif(trim(ticker), '')), '[ ./-]+([A-Z])$', '.\\1') AS ticker
  FROM chars_final_with_names WHERE permno IS NOT NULL),
final AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY permno, eom ORDER BY delivery_id DESC) = 1),
filled AS (
  SELECT permno, eom,
    coalesce(last_value(gvkey IGNORE NULLS) OVER p, first_value(gvkey IGNORE NULLS) OVER f) AS gvkey,
    coalesce(last_value(iid IGNORE NULLS) OVER p, first_value(iid IGNORE NULLS) OVER f) AS iid,
    coalesce(last_value(ticker IGNORE NULLS) OVER p, first_value(ticker IGNORE NULLS) OVER f) AS ticker
  FROM final WINDOW p AS (PARTITION BY permno ORDER BY eom ROWS UNBOUNDED PRECEDING),
    f AS (PARTITION BY permno ORDER BY eom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _window_total(column: str, days: int) -> str:
    kept = f"FILTER (filing_date >= TIMESTAMP '2022-07-01' - INTERVAL {days} DAY)"
    value = f"count(*) {kept}" if column == "n" else f"CAST(coalesce(sum({column}) {kept}, 0) AS BIGINT)"
    return f"{value} AS {column}_{days}d"


def _pivot_name(event_type: str) -> str:
    return f"'t_' || rtrim(regexp_replace({event_type}, '[^0-9A-Za-z]+', '_', 'g'), '_')"


_KNOWN = """
WITH f AS (SELECT DISTINCT document_id, permno, filing_date FROM filings_8k
           WHERE filing_date >= '2015-01-01' AND filing_date < '2026-09-01' AND permno IS NOT NULL),
c AS (SELECT DISTINCT permno, loaded_at, eom, delivery_id, gvkey, iid, gics, size_grp, CASE WHEN isfinite(me) THEN me END AS me, CASE WHEN isfinite(prc) THEN prc END AS prc
  FROM chars_final_with_names),
best AS (SELECT f.document_id, f.permno, f.filing_date, c.* EXCLUDE (permno) FROM f {join} JOIN c ON f.permno = c.permno AND c.loaded_at <= f.filing_date
  QUALIFY row_number() OVER (PARTITION BY f.document_id, f.permno, f.filing_date ORDER BY c.eom DESC NULLS LAST, c.delivery_id DESC NULLS LAST) = 1)
SELECT {columns} FROM best"""

ORACLE = {
    "p2_found": f"WITH {_TYPED} SELECT permno, event_type, newest_id AS document_id FROM ({_FEATURES} FROM typed GROUP BY permno, event_type)",
    "p2_features": f"""WITH {_TYPED}, features AS (SELECT permno, {_pivot_name("event_type")} AS t, count(*) AS n,
    CAST(max(filing_date) AS DATE) AS newest, CAST(coalesce(sum(text_chars), 0) AS BIGINT) AS text_chars, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS word_count,
    count(*) FILTER (filing_date >= TIMESTAMP '2026-09-01' - INTERVAL 365 DAY) AS n_365d FROM typed GROUP BY permno, event_type)
FROM features PIVOT (coalesce(first(n), 0) AS n, first(newest) AS newest, coalesce(first(text_chars), 0) AS text_chars, coalesce(first(word_count), 0) AS word_count,
  coalesce(first(n_365d), 0) AS n_365d FOR t IN ({', '.join("'t_" + t.replace('.', '_').replace('(', '_').replace(')', '') + "'" for t in ITEM_TYPES)}) GROUP BY permno)""",
    "p2_windows": f"WITH {_TYPED} {_FEATURES}, {', '.join(_window_total(c, d) for d in (30, 365) for c in ('n', *TOTALS))} FROM typed WHERE filing_date < '2022-07-01' GROUP BY permno, event_type",
    "p3_found": _KNOWN.format(join="", columns="document_id, strftime(eom, '%Y-%m-%d') AS eom, delivery_id"),
    "p3_attributes": _KNOWN.format(
        join="LEFT",
        columns="document_id, permno, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date, strftime(eom, '%Y-%m-%d') AS eom, delivery_id, gvkey, iid, gics, size_grp, me, prc, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at",
    ),
    "p4_found": """SELECT DISTINCT permno, strftime(eom, '%Y-%m-%d') AS eom, delivery_id, 'beta_60m' AS field_name FROM chars_final_with_names
  WHERE beta_60m IS NULL OR isnan(beta_60m) OR abs(beta_60m) > 10
UNION ALL SELECT DISTINCT permno, strftime(eom, '%Y-%m-%d'), delivery_id, 'gics' FROM chars_final_with_names
  WHERE gics IS NULL OR trim(gics) NOT IN (SELECT gics FROM gics_codes)""",
    "p4_known": """SELECT DISTINCT permno, strftime(eom, '%Y-%m-%d') AS eom, delivery_id, CASE WHEN NOT b THEN beta_60m END AS beta_60m, CASE WHEN NOT g THEN trim(gics) END AS gics, b AS beta_60m_filled, g AS gics_filled
  FROM (SELECT *, beta_60m IS NULL OR isnan(beta_60m) OR abs(beta_60m) > 10 AS b, gics IS NULL OR trim(gics) NOT IN (SELECT gics FROM gics_codes) AS g FROM chars_final_with_names)""",
    "p5_found": f"""WITH {_FINAL},
marked AS (SELECT *, CASE WHEN (gvkey, iid, ticker) IS NOT DISTINCT FROM lag((gvkey, iid, ticker)) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts
  FROM filled WINDOW w AS (PARTITION BY permno ORDER BY eom)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY permno ORDER BY eom ROWS UNBOUNDED PRECEDING) AS version FROM marked)
SELECT permno, strftime(min(eom), '%Y-%m-%d') AS valid_from, strftime(max(eom), '%Y-%m-%d') AS valid_to, gvkey, iid, ticker
FROM numbered GROUP BY permno, version, gvkey, iid, ticker""",
    "p5_changes": f"""WITH {_FINAL},
n AS (SELECT *, year(eom) * 12 + month(eom) AS m FROM filled),
e AS (SELECT coalesce(a.permno, b.permno) AS permno, strftime(a.eom, '%Y-%m-%d') AS at, strftime(b.eom, '%Y-%m-%d') AS seen, CASE WHEN b.permno IS NULL THEN 'inserted' WHEN a.permno IS NULL THEN 'deleted'
    WHEN (a.gvkey, a.iid, a.ticker) IS DISTINCT FROM (b.gvkey, b.iid, b.ticker) THEN 'changed' END AS kind,
    CASE WHEN a.permno IS NULL THEN b.gvkey ELSE a.gvkey END AS gvkey, CASE WHEN a.permno IS NULL THEN b.iid ELSE a.iid END AS iid, CASE WHEN a.permno IS NULL THEN b.ticker ELSE a.ticker END AS ticker
  FROM n a FULL JOIN n b ON a.permno = b.permno AND a.m = b.m + 1)
SELECT * FROM e WHERE kind IS NOT NULL""",
}
