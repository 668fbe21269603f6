"""Cleaning of filing texts: cover pages, tails, boilerplate sentences, names and tickers.

Every step is a column expression of its own, so steps can be used and tested singly and a whole cleaning stays in the JVM.
Names differ from row to row; they are matched literally, longest first, by folding the array of a row's variants over
its text. Patterns are Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and words of the cleaning rules.
ITEM = r"I\s*t\s*e\s*m\.?\s{0,3}\d\s{0,2}\.\s{0,2}\d\s{0,2}\d"
TAIL = r"I\s*t\s*e\s*m\.?\s{0,3}9\s{0,2}\.\s{0,2}0\s{0,2}1|SIGNATURES?\b|Pursuant\s+to\s+the\s+requirements\s+of\s+the\s+Securities\s+Exchange\s+Act"
CONTENTS = r"TABLE\s+OF\s+CONTENTS"
REFERENCE = r",?\s*(?:which is |and is |is\s+)?hereby\s+incorporated\s+(?:herein\s+)?by\s+reference(?:\s+in\s+its\s+entirety)?\.?"
FORWARD = ("forward-looking statements?", "Private Securities Litigation Reform Act", "undue reliance")
SUFFIXES = ("incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "holdings?", "group", "international", "intl", "plc", "llc", r"l\.l\.c\.", "lp", r"l\.p\.")
MARKERS = (r"NYSE\s+American", "NYSE", "Nasdaq", r"ticker\s+symbol")
TITLE_END = r"\.\s+(?=On\s)"
SENTENCE = r"(?<=[.!?])\s+"
JURISDICTION = r"\s*[/(][A-Za-z]{2,6}[/)]\s*$"
COVER = 1500
TITLE_WINDOW = 300
MASK = "the Company"


def _as(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _place(text: Column, pattern: str) -> Column:
    """Position (from 1) of the first match, 0 without one."""
    return F.coalesce(F.regexp_instr(text, F.lit("(?iU)" + pattern)), F.lit(0))


def body_start(text: Column | str) -> Column:
    """Where the body starts: at the first item header; if a table of contents comes before it, at the next place where that
    header is repeated; without any header after the cover, if the text is longer than that."""
    t = _as(text)
    header = F.regexp_substr(t, F.lit("(?iU)" + ITEM))
    first = _place(t, ITEM)
    again = F.coalesce(F.position(header, t, first + F.length(header)), F.lit(0))
    listed = t.substr(F.lit(1), first - 1).rlike("(?iU)" + CONTENTS)
    return F.when(first > 0, F.when(listed & (again > 0), again).otherwise(first)).when(F.length(t) > COVER, F.lit(COVER + 1)).otherwise(F.lit(1))


def has_item(text: Column | str) -> Column:
    return _as(text).rlike("(?iU)" + ITEM)


def drop_cover(text: Column | str) -> Column:
    t = _as(text)
    return t.substr(body_start(t), F.length(t))


def cut_tail(text: Column | str) -> Column:
    """Up to the exhibit item, the signatures or the closing formula."""
    t = _as(text)
    end = _place(t, "(?:" + TAIL + ")")
    return F.when(end > 0, t.substr(F.lit(1), end - 1)).otherwise(t)


def skip_title(text: Column | str) -> Column:
    """Without the title, if a sentence that starts with "On" follows within the first characters."""
    t = _as(text)
    head = F.substring(t, 1, TITLE_WINDOW)
    hit = F.regexp_substr(head, F.lit(TITLE_END))
    return F.when(hit.isNotNull(), t.substr(F.regexp_instr(head, F.lit(TITLE_END)) + F.length(hit), F.length(t))).otherwise(t)


def drop_references(text: Column | str) -> Column:
    return F.regexp_replace(_as(text), "(?iU)" + REFERENCE, ".")


def is_boilerplate(sentence: Column | str) -> Column:
    """Furnished-or-filed disclaimers and forward-looking notices."""
    s = _as(sentence)
    disclaimer = s.rlike("(?iU)not be deemed") & (s.rlike("(?iU)furnished") | s.rlike(r"(?iU)\bfiled\b"))
    return disclaimer | s.rlike("(?iU)" + "|".join(FORWARD))


def drop_boilerplate(text: Column | str) -> Column:
    return F.array_join(F.filter(F.split(_as(text), SENTENCE), lambda s: ~is_boilerplate(s)), " ")


def strip_suffix(name: Column | str) -> Column:
    """A company name without its legal suffixes and trailing jurisdictions, however many follow each other: the whole run of them
    up to the end is taken off by one pattern."""
    ending = r"(?iU)(?:" + JURISDICTION.removesuffix("$") + r"|(?:[,.]|\s)+(?:" + "|".join(SUFFIXES) + r")\.?\s*)+$"
    return F.trim(F.regexp_replace(F.trim(_as(name)), ending, ""))


def name_variants(names: Sequence[Column | str]) -> tuple[Column, Column]:
    """Full names as written, and short ones (without suffix) of three or more characters that have two words or six
    characters; each an array, longest first."""
    full = F.array_distinct(F.filter(F.array(*[F.trim(_as(n)) for n in names]), lambda n: n.isNotNull() & (n != "")))
    short = F.filter(F.array_distinct(F.transform(full, lambda n: strip_suffix(n))), lambda s: (F.length(s) >= 3) & ((F.size(F.split(s, r"\s+")) >= 2) | (F.length(s) >= 6)))
    longest = lambda a: F.transform(F.array_sort(F.transform(a, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: x["n"])
    return longest(full), longest(short)


def _quoted(literal: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mask_all(text: Column | str, variants: Column, flags: str) -> Column:
    """Each variant as a whole word replaced, one after the other."""
    pattern = lambda v: F.concat(F.lit(f"(?{flags})(?<!\\w)"), _quoted(v), F.lit(r"(?!\w)"))
    return F.aggregate(variants, _as(text), lambda t, v: F.regexp_replace(t, pattern(v), F.lit(MASK)))


def mask_ticker(text: Column | str, ticker: Column | str) -> Column:
    """The ticker, only where an exchange or the words "ticker symbol" stand before it."""
    t, k = _as(text), _as(ticker)
    pattern = F.concat(F.lit("(?iU)((?:" + "|".join(MARKERS) + r')[:\s]+"?)'), _quoted(k), F.lit(r"(?!\w)"))
    return F.when(F.length(k) >= 2, F.regexp_replace(t, pattern, F.lit("$1" + MASK))).otherwise(t)


def clean_text(df: DataFrame, text: str, names: Sequence[str], ticker: str, into: str = "clean") -> DataFrame:
    """``df`` with the cleaned ``text``: '' for a null text or one with nothing left. The steps are applied in sequence, each as a
    projection, so that a step's result is computed once."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_item", has_item(body)).withColumn(into, cut_tail(drop_cover(body)))
    out = out.withColumn(into, F.when(F.col("_item"), skip_title(into)).otherwise(F.col(into)))
    out = out.withColumn(into, drop_boilerplate(drop_references(into)))
    full, short = name_variants(names)
    out = out.withColumn(into, mask_all(mask_all(into, full, "iU"), short, "U"))
    out = out.withColumn(into, F.coalesce(mask_ticker(into, ticker), into))
    return out.withColumn(into, F.trim(F.regexp_replace(into, r"(?U)\s+", " "))).drop("_item")
