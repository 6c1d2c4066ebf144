"""Hand-checked values."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.json_text import strip_fences, with_json
from foliospark.functions.marks import spans, without_marks
from foliospark.operators import delivery, intake, pricing, vouchers

NOW = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def cart(spark, words, languages, upsells=(), code=None):
    ddl = "word_count bigint, languages array<string>, upsells array<string>, voucher_input string"
    return spark.createDataFrame([(words, list(languages), list(upsells), code)], ddl)


def test_prices(spark):
    price = lambda w, ls: pricing.quote(cart(spark, w, ls)).first()["translation_price"]
    assert price(65000, ["es", "fr", "de", "pt"]) == D("882.00")
    assert price(1000, ["es", "fr", "de"]) == D("337.50")
    assert price(1000, []) == D("0.00")
    assert price(None, ["es"]) == D("0.00")
    assert price(1000, ["es", "fr", "de", "pt", "it"]) == D("472.50")


def test_tiers(spark):
    rows = spark.createDataFrame([(w,) for w in (0, 30000, 30001, 80000, 80001, 150000, 150001, 900000)], "w bigint")
    want = ["small", "small", "medium", "medium", "large", "large", "large", "large"]
    got = [r[0] for r in rows.select(pricing.tier_of("w")).collect()]
    by_band = {r["w"]: r["tier"] for r in pricing.assign_tier_by_bands(rows, "w").collect()}
    assert got == want
    assert [by_band[r["w"]] for r in rows.collect()] == want
    flags = [r[0] for r in rows.select(pricing.over_limit("w")).collect()]
    assert flags == [False] * 6 + [True] * 2


def test_addons(spark):
    total = lambda ls, ups: pricing.quote(cart(spark, 1, ls, ups)).first()["addon_total"]
    assert total(["es"], ["launch-pack"]) == 29
    assert total(["es", "fr"], ["launch-pack"]) == 49
    assert total(["es"], ["nonsense"]) == 0
    assert total(["es"], ["newsletter", "newsletter"]) == 198
    assert total(["es"], ["launch-pack", "newsletter", "author-list", "full-promo"]) == 526


def discounted(spark, subtotal, code):
    df = spark.createDataFrame([(D(subtotal), code)], "total decimal(12,2), voucher_input string")
    return vouchers.apply_voucher(df, NOW).first()


def test_vouchers(spark):
    row = discounted(spark, "30.00", "FIRST50")
    assert (row.discount_amount, row.charged_total) == (D("30.00"), D("1.00"))
    row = discounted(spark, "100.00", "  launch20 ")
    assert (row.voucher_code, row.discount_amount, row.charged_total) == ("LAUNCH20", D("20.00"), D("80.00"))
    row = discounted(spark, "337.50", "AUTHOR25")
    assert (row.discount_amount, row.shown_total, row.charged_cents) == (D("84.38"), D("253.12"), 25313)
    assert discounted(spark, "386.50", "BETA95").discount_amount == D("367.18")
    assert discounted(spark, "10.00", "NOPE").reject_reason == "unknown_code"
    assert discounted(spark, "10.00", " first50\n").voucher_code == "FIRST50"
    for nothing in ("", None):
        row = discounted(spark, "0.00", nothing)
        assert (row.reject_reason, row.voucher_code, row.shown_total, row.charged_cents) == (None, None, D("0.00"), 100)


def test_unknown_amount_stays_unknown(spark):
    row = discounted_null = spark.createDataFrame([(None, None)], "total decimal(12,2), voucher_input string")
    row = vouchers.apply_voucher(discounted_null, NOW).first()
    assert row.charged_cents is None and row.shown_total is None


def test_words(spark):
    texts = ["", "  ", "a", "a b", " a b ", "a﻿b c", "x\n\n\ty", "a\u0085b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(text.word_count("t")).collect()]
    assert got == [0, 0, 1, 2, 2, 3, 2, 1]


def test_names(spark):
    assert one(spark, text.title_from_name("n"), n="my_book.v2.txt") == "my book.v2"
    assert one(spark, text.title_from_name("n"), n="no_dot") == "no dot"
    assert one(spark, text.extension("n"), n="a.b.TXT") == "txt"
    assert one(spark, text.extension("n"), n="noext") == "noext"
    assert one(spark, intake.estimated_words("n"), n=100) == 17
    assert [one(spark, intake.estimated_words("n"), n=n) for n in (0, 2, 3, 8, 9)] == [0, 0, 1, 1, 2]
    assert one(spark, delivery.file_name("t", "l"), t="T", l="es") == "T_Spanish.txt"
    assert one(spark, delivery.file_name("t", "l"), t="T", l="xx") == "T_xx.txt"
    assert one(spark, delivery.order_reference("s"), s="cs_1234567890123456") == "567890123456"


def test_numbers_in_text(spark):
    assert one(spark, text.leading_int("n"), n=" 42 words") == 42
    assert one(spark, text.leading_int("n"), n="words") is None
    assert one(spark, text.thousands("n"), n=1234567) == "1,234,567"


def test_marks_and_fences(spark):
    marked = "[[ORIGINAL: El hombre]]El otro."
    assert one(spark, spans("t"), t=marked) == ["El hombre"]
    assert one(spark, without_marks("t"), t=marked) == "El otro."
    assert one(spark, without_marks("t"), t="a [[ORIGINAL: b\nc]]d [[ORIGINAL: ]]e") == "a d e"
    assert one(spark, strip_fences("t"), t='```json\n{"a":1}\n```') == '{"a":1}'


def test_strict_json(spark):
    texts = {
        '{"a": 1}': 1, ' {"a": 1} ': 1, '{"a": 1} x': None, '{"a": 1}{"a": 2}': None, '{"a": 1},{"a": 2}': None,
        "{'a': 1}": None, "": None, "text": None, "null": None, "[]": None, '{"a": NaN}': None, '{"a": 1}]': None,
        '{"a": 1}]}': None, '{"a": 1': None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p and r.p["a"] for r in with_json(df, "p", "t", "struct<a:int>").collect()}
    assert got == texts
