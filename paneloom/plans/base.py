"""Registration of queries, the shared input frames and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions.columns import finite
from paneloom.operators.history import latest_delivery
from paneloom.operators.series import next_month
from paneloom.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the nudge decides exact halves alike in Spark and SQL."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + F.lit(1e-9), digits)


def rs(sql: str, digits: int = 6) -> str:
    return f"round(({sql}) + 1e-9, {digits})"


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def ds(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


#: Usable values of the panel's columns; everything else is null.
_USABLE = {
    "me": lambda c: F.when(c > 0, c), "prc": lambda c: F.when(c > 0, c), "ret": lambda c: F.when(c >= -1, c), "ret_exc": lambda c: F.when(c >= -1.5, c),
    "ret_exc_lead1m": lambda c: F.when(c >= -1.5, c), "beta_60m": lambda c: F.when(F.abs(c) <= 10, c),
}
NUMBERS = ("prc", "me", "ret", "ret_exc", "ret_exc_lead1m", "beta_60m", "dolvol_126d", "be_me", "gp_at", "ret_12_1", "ivol_capm_252d", "age", "at_be")
CHARACTERISTICS = ("be_me", "gp_at", "ret_12_1", "ivol_capm_252d", "dolvol_126d", "beta_60m")


def panel(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per security and month, of its highest delivery: ``permno, eom`` and ``columns``, unusable values null."""
    names = {"gics2": "gics"}
    read = list(dict.fromkeys(names.get(c, c) for c in columns))
    rows = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", *[c for c in read if c != "delivery_id"]])
    final = latest_delivery(rows.where("permno is not null and eom is not null"), ["permno", "eom"], "delivery_id", [c for c in read if c != "delivery_id"])
    code = F.trim("gics")
    made = []
    for c in columns:
        if c == "gics2":
            made.append(F.when(code.rlike("^[1-9][0-9]{7}$"), F.substring(code, 1, 2)).otherwise("NA").alias(c))
        elif c in NUMBERS:
            x = finite(c)
            made.append(_USABLE.get(c, lambda v: v)(x).alias(c))
        else:
            made.append(F.col(c))
    return final.select("permno", "eom", *made)


def _fin(c: str, more: str = "") -> str:
    return f"CASE WHEN isfinite({c}){more} THEN {c} END AS {c}"


CTE = {
    "panel": f"""panel AS (SELECT permno, eom, delivery_id, size_grp, ticker, company_name, CAST(date AS DATE) AS date, {_fin('prc', ' AND prc > 0')}, {_fin('me', ' AND me > 0')}, {_fin('ret', ' AND ret >= -1')},
  {_fin('ret_exc', ' AND ret_exc >= -1.5')}, {_fin('ret_exc_lead1m', ' AND ret_exc_lead1m >= -1.5')}, {_fin('beta_60m', ' AND abs(beta_60m) <= 10')},
  {', '.join(_fin(c) for c in NUMBERS[6:])},
  CASE WHEN regexp_matches(trim(gics), '^[1-9][0-9]{{7}}$') THEN substr(trim(gics), 1, 2) ELSE 'NA' END AS gics2
  FROM chars_final_with_names WHERE permno IS NOT NULL AND eom IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY permno, eom ORDER BY delivery_id DESC) = 1)""",
    "filings": """filings AS (SELECT document_id, permno, filing_date, last_day(CAST(filing_date AS DATE)) AS eom, items, company_name, ticker FROM filings_8k
  WHERE filing_date >= '2015-01-01' AND filing_date < '2026-09-01' AND permno IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY provider_added_at DESC, company_name DESC, ticker DESC) = 1)""",
    "scores": """scores AS (SELECT document_id, permno, last_day(CAST(filing_date AS DATE)) AS eom, fb_pos, fb_neg, fb_pos - fb_neg AS tone FROM filing_scores
  WHERE max_length = 128 AND permno IS NOT NULL AND filing_date >= '2015-01-01' AND filing_date < '2026-09-01')""",
    # A long/short book: each month the ten strongest and the ten weakest by past return of the larger half, equally weighted.
    "book": """book_side AS (SELECT p.*, row_number() OVER (PARTITION BY eom ORDER BY ret_12_1 DESC, permno) AS up, row_number() OVER (PARTITION BY eom ORDER BY ret_12_1, permno) AS down
  FROM panel p WHERE ret_12_1 IS NOT NULL AND me IS NOT NULL),
book AS (SELECT last_day(eom + INTERVAL 1 DAY) AS month, eom, permno, 1 AS side, 0.1 AS weight, ret_exc_lead1m AS ret, ticker, company_name, me, dolvol_126d, size_grp, beta_60m, gics2 FROM book_side WHERE up <= 10
  UNION ALL SELECT last_day(eom + INTERVAL 1 DAY), eom, permno, -1, -0.1, ret_exc_lead1m, ticker, company_name, me, dolvol_126d, size_grp, beta_60m, gics2 FROM book_side WHERE down <= 10)""",
    "ledger": """changes AS (SELECT coalesce(a.month, last_day(b.month + INTERVAL 1 DAY)) AS month, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS moved
  FROM book a FULL JOIN book b ON a.permno = b.permno AND a.side = b.side AND a.month = last_day(b.month + INTERVAL 1 DAY) GROUP BY 1),
legs AS (SELECT month, round(coalesce(sum(weight * coalesce(ret, 0)) FILTER (weight > 0), 0), 12) AS long_ret, round(coalesce(sum(weight * coalesce(ret, 0)) FILTER (weight < 0), 0), 12) AS short_ret, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short,
    sum(abs(weight)) AS gross, round(sum(weight), 12) AS net, sum(weight * coalesce(beta_60m, 0)) AS beta_exante, coalesce(sum(abs(weight)) FILTER (ret IS NULL), 0) AS missing_ret_weight FROM book GROUP BY month),
paid AS (SELECT l.*, long_ret + short_ret AS ls_ret, 0.5 * moved / 2.0 AS turnover, 10 / 10000.0 * moved AS cost, rf_m, sp500_ret, sp500_exret, rf_m + (long_ret + short_ret) + coalesce(net * (rf_pipe - rf_m), 0) AS total_ret, rf_m + 0.04 / 12 AS bench_ret, month = (SELECT min(month) FROM legs) AS first_month
  FROM legs l JOIN changes USING (month) JOIN (SELECT CAST(eom AS DATE) AS month, rf_m, rf_pipe, sp500_ret, sp500_exret FROM market_monthly) USING (month)),
ledger AS (SELECT *, total_ret - bench_ret AS active_ret, total_ret - cost AS total_ret_net, total_ret - bench_ret - cost AS active_ret_net FROM paid)""",
}
_NEEDS = {"book": ["panel"], "ledger": ["book"]}


def with_(body: str, *names: str) -> str:
    """SQL of ``body`` with the named shared tables before it; ``body`` may go on with tables of its own after a comma."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in found:
            found.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in found) + ("\n" if body.lstrip().upper().startswith("SELECT") or body.lstrip().startswith(",") else ",\n") + body


def filings(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each filing in span with a security once, in its latest version: ``document_id, permno, filing_date, eom`` and ``columns``."""
    from paneloom.operators.cross import first_per_key

    read = list(dict.fromkeys(["document_id", "permno", "filing_date", *columns, "provider_added_at", "company_name", "ticker"]))
    rows = table(spark, folder, "filings_8k", read)
    rows = rows.where("filing_date >= '2015-01-01' and filing_date < '2026-09-01' and permno is not null")
    once = first_per_key(rows, ["document_id"], [F.desc("provider_added_at"), F.desc("company_name"), F.desc("ticker")])
    return once.select("document_id", "permno", "filing_date", F.last_day("filing_date").alias("eom"), *columns)


def scores(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "filing_scores", ["document_id", "permno", "filing_date", "fb_pos", "fb_neg", "max_length", *columns])
    rows = rows.where("max_length = 128 and permno is not null and filing_date >= '2015-01-01' and filing_date < '2026-09-01'")
    return rows.select("document_id", "permno", F.last_day("filing_date").alias("eom"), "fb_pos", "fb_neg", (F.col("fb_pos") - F.col("fb_neg")).alias("tone"), *columns)


def market(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "market_monthly").withColumnRenamed("eom", "month")


def book(spark: SparkSession, folder: str) -> DataFrame:
    """A long/short book: each month the ten strongest and the ten weakest securities by past return, weights of 0.1 and -0.1."""
    from paneloom.operators.cross import top_bottom

    rows = panel(spark, folder, "ret_12_1", "me", "ret_exc_lead1m", "ticker", "company_name", "dolvol_126d", "size_grp", "beta_60m", "gics2").where("me is not null")
    sided = top_bottom(rows, "ret_12_1", ["eom"], 10, "permno")
    return sided.select(next_month("eom").alias("month"), "eom", "permno", "side", (F.col("side") * F.lit(0.1)).alias("weight"), F.col("ret_exc_lead1m").alias("ret"), "ticker", "company_name", "me", "dolvol_126d", "size_grp", "beta_60m", "gics2")
