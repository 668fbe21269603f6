"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column | str) -> Column:
    """``value`` if it is a finite number, else null."""
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clean_text(value: Column | str) -> Column:
    """``value`` without surrounding blanks; null if nothing is left."""
    c = F.trim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"^[\s ]+|[\s ]+$", ""))
    return F.when(c != "", c)


def month_number(day: Column | str) -> Column:
    """Months since year 0; consecutive months differ by one."""
    return F.year(day) * 12 + F.month(day)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that are no columns of ``df``, so that helper columns never meet given ones."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        made.append(name)
    return made
