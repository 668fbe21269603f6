from paneloom.operators import text
from pyspark.sql import functions as F

BODY = 'Item 8.01. Other Events. On June 1, 2024, Acme Widgets Corp bought ACME shares under the ticker symbol "ACME". An acmen stayed. '


def cleaned(spark, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "t string, a string, b string, k string, i int")
    return [r["clean"] for r in text.clean_text(df, "t", ["a", "b"], "k").orderBy("i").collect()]


def test_cover_title_names_and_ticker(spark):
    (out,) = cleaned(spark, ("FORM 8-K cover of Acme Widgets Corp " + BODY, "Acme Widgets Corp", None, "ACME"))
    assert out == 'On June 1, 2024, the Company bought ACME shares under the ticker symbol "the Company". An acmen stayed.'


def test_ticker_only_after_a_marker(spark):
    (out,) = cleaned(spark, ("Item 1.01 On NYSE: MA shares require MA state approval.", None, None, "MA"))
    assert out == "Item 1.01 On NYSE: the Company shares require MA state approval."


def test_tail_boilerplate_and_reference(spark):
    t = "Item 2.02 Facts happened. The information is furnished and shall not be deemed filed. See undue reliance notes. The exhibit is hereby incorporated by reference. More facts. SIGNATURES rest"
    (out,) = cleaned(spark, (t, None, None, None))
    assert out == "Item 2.02 Facts happened. The exhibit. More facts."


def test_contents_header_is_skipped(spark):
    t = "TABLE OF CONTENTS Item 1.01 Entry 3 pages. Item 1.01 The real event."
    assert cleaned(spark, ("Cover TABLE OF CONTENTS Item 1.01 Entry 3. Item 1.01 The real event.", None, None, None), (t, None, None, None)) == ["Item 1.01 The real event."] * 2


def test_null_empty_short_and_long(spark):
    out = cleaned(spark, (None, None, None, None), ("", "A", "B", "C"), ("short text", None, None, None), ("x" * 1500 + "kept", None, None, None))
    assert out == ["", "", "short text", "kept"]


def test_names_with_pattern_characters(spark):
    (out,) = cleaned(spark, (r"Item 1.01 A+B (X) \E Ltd. grew.", r"A+B (X) \E Ltd.", None, "$1"))
    assert out == "Item 1.01 the Company grew."


def test_strip_suffix(spark):
    df = spark.createDataFrame([("Acme Widgets, Inc.",), ("Foo Holdings Group Ltd",), ("Bar Corp /DE/",), ("Box",), ("",)], "n string")
    assert [r[0] for r in df.select(text.strip_suffix("n")).collect()] == ["Acme Widgets", "Foo", "Bar", "Box", ""]


def test_short_variants_need_length(spark):
    df = spark.createDataFrame([("Box Inc", "Acme Widgets Corp")], "a string, b string")
    full, short = text.name_variants(["a", "b"])
    row = df.select(full.alias("f"), short.alias("s")).first()
    assert row["f"] == ["Acme Widgets Corp", "Box Inc"] and row["s"] == ["Acme Widgets"]


def test_boilerplate_predicate(spark):
    df = spark.createDataFrame([("shall not be deemed filed",), ("furnished only",), ("Forward-Looking statement",), (None,)], "s string")
    assert [r[0] for r in df.select(F.coalesce(text.is_boilerplate("s"), F.lit(False))).collect()] == [True, False, True, False]


def test_any_number_of_suffixes(spark):
    names = ["Acme " + "Holdings Inc. " * 12 + "/DE/", "Group", "A.Co.Inc", "Cold  Company , Ltd. (UK) /NV/", "Incline Co-op", "", None, "X Corp (Delaware)"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(text.strip_suffix("n")).collect()] == ["Acme", "Group", "A", "Cold", "Incline Co-op", "", None, "X Corp (Delaware)"]
