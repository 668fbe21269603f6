"""Queries p7 to p9: packing and mixing the documents, and their subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm.mixing import make_plan, measured, mixture, source_name
from paneloom.llm.packing import pack
from paneloom.llm.subjects import assign_subjects, labelled_sample, train
from paneloom.llm.tokens import RANKS, count_tokens
from paneloom.session import materialize
from paneloom.sources import table


def document_sizes(spark: SparkSession, folder: str, *keep: str, ranks: str = RANKS) -> DataFrame:
    """Documents without their texts, with ``n_tokens``; tokenized once and kept in the shared folder for later passes."""
    return materialize(count_tokens(table(spark, folder, "documents", ["text", *keep]), path=ranks), "sizes")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's pieces with their containers of ``capacity_tokens``."""
    capacity = table(spark, folder, "pack_limits").first()["capacity_tokens"]
    return pack(document_sizes(spark, folder, "doc_id"), "n_tokens", capacity, ["doc_id"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_containers(spark, folder).where("piece > 0").select("doc_id").distinct()


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: their number, their tokens and the share of the room that is used."""
    capacity = table(spark, folder, "pack_limits").first()["capacity_tokens"]
    full = p7_containers(spark, folder).where("container is not null").groupBy("container").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return full.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("used_share"))


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The documents packed by their characters, which SQL can count: pieces, characters placed and longest piece of each."""
    capacity = table(spark, folder, "pack_limits").first()["capacity_tokens"]
    sizes = table(spark, folder, "documents", ["doc_id", "text"]).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    pieces = pack(materialize(sizes, "sizes"), "n_chars", capacity, ["doc_id"])
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("placed"), F.max("length").alias("longest"), F.max(F.col("offset") + F.col("length")).alias("reach"))


def _mixed(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    sizes = sizes.withColumn("source", source_name("source"))
    histogram, plan, report = make_plan(sizes, targets)
    return mixture(sizes, histogram, plan), report


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the mixture by source."""
    return measured(*_mixed(document_sizes(spark, folder, "doc_id", "source"), table(spark, folder, "mix_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that the mixture holds with all their repeats and still below their share."""
    return p8_shares(spark, folder).where("limited").select("source")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: documents and how often each is used."""
    return _mixed(document_sizes(spark, folder, "doc_id", "source"), table(spark, folder, "mix_targets"))[0]


def p8_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture by characters, which SQL can count: sizes, budgets, limited sources and, for these, the characters in the mixture."""
    sizes = table(spark, folder, "documents", ["doc_id", "source", "text"]).select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    out = measured(*_mixed(materialize(sizes, "sizes"), table(spark, folder, "mix_targets")))
    return out.select("source", "target_share", "max_repeats", "source_tokens", "budget", "limited", F.when(F.col("limited"), F.col("tokens")).alias("tokens_if_limited"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the array of its subjects."""
    documents = table(spark, folder, "documents", ["doc_id", "text", "source"])
    model = train(*labelled_sample(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas")))
    return assign_subjects(documents, model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_documents(spark, folder).select("doc_id", F.explode("subjects").alias("subject")).distinct()


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Make-up of the corpus: documents by source and subject; a document of several subjects counts in equal parts."""
    by = p9_documents(spark, folder).select(source_name("source").alias("source"), F.explode("subjects").alias("subject"), (1 / F.size("subjects")).alias("part"))
    return by.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("part"), 6).alias("weight"))


QUERIES = {f.__name__: f for f in (p7_found, p7_containers, p7_fill, p7_lengths, p8_found, p8_mixture, p8_shares, p8_lengths, p9_found, p9_documents, p9_composition)}
#: Token counts and subjects can't be expressed in SQL: tests/llm has brute-force versions and held-out accuracy.
ORACLE = {
    "p7_lengths": """SELECT doc_id, CAST(greatest(1, ceil(n / c)) AS BIGINT) AS pieces, CAST(n AS BIGINT) AS placed, CAST(least(n, c) AS BIGINT) AS longest, CAST(n AS BIGINT) AS reach
  FROM (SELECT doc_id, coalesce(length(text), 0) AS n, (SELECT capacity_tokens FROM pack_limits) AS c FROM documents)""",
    "p8_lengths": r"""WITH d AS (SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, coalesce(length(text), 0) AS n FROM documents),
s AS (SELECT t.source, t.target_share, t.max_repeats, CAST(coalesce(sum(n), 0) AS BIGINT) AS source_tokens FROM mix_targets t LEFT JOIN d ON d.source = t.source GROUP BY ALL),
b AS (SELECT *, target_share * sum(source_tokens) OVER () AS wanted FROM s)
SELECT source, target_share, max_repeats, source_tokens, CAST(floor(wanted) AS BIGINT) AS budget, source_tokens * max_repeats < wanted AS limited, CASE WHEN source_tokens * max_repeats < wanted THEN source_tokens * max_repeats END AS tokens_if_limited FROM b""",
}
