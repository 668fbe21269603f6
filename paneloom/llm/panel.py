"""Queries p1 and p6: percentiles and top items of the monthly security panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions.columns import finite
from paneloom.llm.percentiles import merge_summaries, percentiles, summarize
from paneloom.llm.topn import top_n
from paneloom.operators.history import latest_delivery
from paneloom.sources import table

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def usable_measures(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per usable figure: ``me`` above 0 and ``ret`` of -1 or more, both finite; each row once by its own
    ``size_grp`` and once under ``all``."""
    me, ret = finite("me"), finite("ret")
    figures = F.array(F.struct(F.lit("me").alias("measure"), F.when(me > 0, me).alias("x")), F.struct(F.lit("ret").alias("measure"), F.when(ret >= -1, ret).alias("x")))
    long = rows.withColumn("_f", F.explode(figures)).where("_f.x is not null").withColumn("_size", F.explode(F.array(F.lit("all"), "size_grp")))
    return long.select("eom", F.col("_size").alias("size_grp"), *keep, F.col("_f.measure").alias("measure"), F.col("_f.x").alias("x"))


def p1_percentiles(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """Exact percentiles of ``me`` and ``ret`` of the final rows by month, and by month and size group."""
    panel = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", "size_grp", "me", "ret"])
    final = latest_delivery(panel, ["permno", "eom"], "delivery_id", ["size_grp", "me", "ret"])
    out = percentiles(usable_measures(final), ["measure", "eom", "size_grp"], "x", PROBS, **options)
    return out.select("measure", F.date_format("eom", "yyyy-MM-dd").alias("eom"), "size_grp", "n", "prob", "percentile", F.lit(0).cast("long").alias("rank_error"))


def p1_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The same with pivot rounds down to eight values a range, which takes several rounds at any size of the tables."""
    return p1_percentiles(spark, folder, finish=8)


def delivery_summaries(spark: SparkSession, folder: str, steps: int = 64) -> DataFrame:
    """Summaries of single deliveries, by month and by month and size group: of the rows that each brought and of the earlier
    rows that it replaced, those in the size group that they had."""
    panel = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", "size_grp", "me", "ret"]).distinct()
    following = F.lead("delivery_id").over(Window.partitionBy("permno", "eom").orderBy("delivery_id"))
    moves = panel.withColumn("_next", following).withColumn("_m", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("delivery_id").alias("at")), F.struct(F.lit(-1).alias("sign"), F.col("_next").alias("at")))))
    moves = moves.where("_m.at is not null").withColumns({"delivery": F.col("_m.at"), "sign": F.col("_m.sign")})
    figures = usable_measures(moves, "delivery", "sign")
    return summarize(figures, ["measure", "eom", "size_grp", "delivery", "sign"], "x", steps)


def p1_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the final rows by month, and by month and size group, put together from the summaries of single deliveries, with
    error bounds."""
    merged = merge_summaries(delivery_summaries(spark, folder), ["delivery"], ["measure", "eom", "size_grp"], PROBS, sign="sign")
    return merged.withColumn("eom", F.date_format("eom", "yyyy-MM-dd"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    panel = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", "me"])
    final = latest_delivery(panel, ["permno", "eom"], "delivery_id", ["me"]).where(finite("me") > 0)
    return top_n(final.select("eom", "permno", "me"), ["eom"], "me", 20, ["permno"]).select(F.date_format("eom", "yyyy-MM-dd").alias("eom"), "permno")


def p6_ret(spark: SparkSession, folder: str) -> DataFrame:
    """The ten lowest usable returns of each month and size group, with their values; many returns tie."""
    panel = table(spark, folder, "chars_final_with_names", ["permno", "eom", "delivery_id", "size_grp", "ret"])
    final = latest_delivery(panel, ["permno", "eom"], "delivery_id", ["size_grp", "ret"]).where(finite("ret") >= -1)
    top = top_n(final.select("eom", "size_grp", "permno", "ret"), ["eom", "size_grp"], "ret", 10, ["permno"], largest=False)
    return top.withColumn("eom", F.date_format("eom", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_rounds, p1_deliveries, p6_found, p6_ret)}

_FINAL = """WITH final AS (SELECT permno, eom, delivery_id, size_grp, me, ret FROM chars_final_with_names
  QUALIFY row_number() OVER (PARTITION BY permno, eom ORDER BY delivery_id DESC) = 1)"""

_PERCENTILES = f"""{_FINAL},
f AS (SELECT 'me' AS measure, eom, size_grp, me AS x FROM final WHERE me > 0 AND NOT isnan(me) AND NOT isinf(me)
  UNION ALL SELECT 'ret', eom, size_grp, ret FROM final WHERE ret >= -1 AND NOT isnan(ret) AND NOT isinf(ret)),
g AS (SELECT measure, eom, 'all' AS size_grp, x FROM f UNION ALL SELECT * FROM f),
p AS (SELECT CAST(unnest([{", ".join(map(str, PROBS))}]) AS DOUBLE) AS prob),
q AS (SELECT measure, eom, size_grp, count(*) AS n, list(x ORDER BY x) AS v FROM g GROUP BY measure, eom, size_grp),
r AS (SELECT *, (n - 1) * prob AS spot FROM q, p)
SELECT measure, strftime(eom, '%Y-%m-%d') AS eom, size_grp, n, prob, CAST(0 AS BIGINT) AS rank_error,
  v[CAST(floor(spot) AS BIGINT) + 1] + (v[CAST(ceil(spot) AS BIGINT) + 1] - v[CAST(floor(spot) AS BIGINT) + 1]) * (spot - floor(spot)) AS percentile FROM r"""

#: The summaries of parts and their sum, as stated for ``merge_summaries``, by sorting.
_DELIVERIES = f"""WITH rows_ AS (SELECT DISTINCT permno, eom, delivery_id, size_grp, me, ret FROM chars_final_with_names),
moved AS (SELECT *, lead(delivery_id) OVER (PARTITION BY permno, eom ORDER BY delivery_id) AS next_ FROM rows_),
moves AS (SELECT *, 1 AS sign, delivery_id AS delivery FROM moved UNION ALL SELECT *, -1, next_ FROM moved WHERE next_ IS NOT NULL),
f AS (SELECT 'me' AS measure, eom, size_grp, delivery, sign, me AS x FROM moves WHERE me > 0 AND isfinite(me) UNION ALL SELECT 'ret', eom, size_grp, delivery, sign, ret FROM moves WHERE ret >= -1 AND isfinite(ret)),
g AS (SELECT * REPLACE ('all' AS size_grp) FROM f UNION ALL SELECT * FROM f),
parts AS (SELECT measure, eom, size_grp, delivery, sign, count(*) AS n, list(x ORDER BY x) AS v FROM g GROUP BY ALL),
spots AS (SELECT DISTINCT measure, eom, size_grp, delivery, sign, n, v, CAST(round(j * (n - 1) / 64.0) AS BIGINT) AS rank_ FROM parts, (SELECT unnest(range(65)) AS j)),
around AS (SELECT *, lag(rank_) OVER w AS b, lead(rank_) OVER w AS a FROM spots WINDOW w AS (PARTITION BY measure, eom, size_grp, delivery, sign ORDER BY rank_)),
bounds AS (SELECT measure, eom, size_grp, v[rank_ + 1] + 0.0 AS x, sign, CASE WHEN b IS NULL THEN n END AS n, rank_ - coalesce(b, -1) AS least_, coalesce(a, n) - CASE WHEN b IS NULL THEN 0 ELSE rank_ END AS most_ FROM around),
at_ AS (SELECT measure, eom, size_grp, x, sum(CASE WHEN sign > 0 THEN least_ ELSE -most_ END) AS l, sum(CASE WHEN sign > 0 THEN most_ ELSE -least_ END) AS u, sum(sign * coalesce(n, 0)) AS n FROM bounds GROUP BY ALL),
total AS (SELECT *, sum(n) OVER p AS total, sum(l) OVER w AS low, sum(u) OVER w AS high FROM at_ WINDOW p AS (PARTITION BY measure, eom, size_grp), w AS (PARTITION BY measure, eom, size_grp ORDER BY x ROWS UNBOUNDED PRECEDING)),
before_ AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY measure, eom, size_grp ORDER BY x), 0) AS before_ FROM total),
asked AS (SELECT *, floor((total - 1) * prob) + 1 AS place FROM before_, (SELECT CAST(unnest([{", ".join(map(str, PROBS))}]) AS DOUBLE) AS prob) WHERE total > 0),
errors AS (SELECT *, greatest(0, place - low, before_ + 1 - place) AS error FROM asked)
SELECT measure, strftime(eom, '%Y-%m-%d') AS eom, size_grp, CAST(total AS BIGINT) AS n, prob, x AS percentile, CAST(error AS BIGINT) AS rank_error FROM errors
QUALIFY row_number() OVER (PARTITION BY measure, eom, size_grp, prob ORDER BY error, x) = 1"""

ORACLE = {
    "p1_percentiles": _PERCENTILES,
    "p1_rounds": _PERCENTILES,
    "p1_deliveries": _DELIVERIES,
    "p6_found": f"""{_FINAL} SELECT strftime(eom, '%Y-%m-%d') AS eom, permno FROM final WHERE me > 0 AND NOT isnan(me) AND NOT isinf(me)
QUALIFY row_number() OVER (PARTITION BY eom ORDER BY me DESC, permno) <= 20""",
    "p6_ret": f"""{_FINAL} SELECT strftime(eom, '%Y-%m-%d') AS eom, size_grp, permno, ret FROM final WHERE ret >= -1 AND NOT isnan(ret) AND NOT isinf(ret)
QUALIFY row_number() OVER (PARTITION BY eom, size_grp ORDER BY ret, permno) <= 10""",
}
