from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import scalars as S
from ledgerspark.functions.similarity import with_similarity


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "paise"), [("1,234.50", 123450), ("₹ 10", 1000), ("(12.34)", -1234), ("-5", -500), ("INR 7.005", 701), ("abc", None), ("", None), (None, None), ("1.2.3", None)])
def test_paise(spark, raw, paise):
    assert one(spark, raw, S.paise) == paise


@pytest.mark.parametrize(("raw", "day"), [("2026-09-05", date(2026, 9, 5)), ("05/09/2026", date(2026, 9, 5)), ("05-Sep-2026", date(2026, 9, 5)), ("2026-09-05T10:00:00+05:30", date(2026, 9, 5)), ("5/9/26", date(2026, 9, 5)), ("soon", None), (None, None)])
def test_dates(spark, raw, day):
    assert one(spark, raw, S.parse_date) == day


def test_grouping(spark):
    df = spark.createDataFrame([(123456789,), (-50,), (None,), (99999,)], "p long").select(S.fmt_inr("p").alias("t"))
    assert [r["t"] for r in df.collect()] == ["₹12,34,567.89", "-₹0.50", "-", "₹999.99"]


def test_names(spark):
    assert one(spark, "Zenith Foods Pvt. Ltd. 12345", S.norm_name) == "ZENITH FOODS"
    pairs = spark.createDataFrame([("ZENITH FOODS", "ZENITH FOOD"), ("ZENITH FOODS", "MARINE WORKS"), ("A", "A")], "a string, b string")
    got = {(r["a"], r["b"]): r["sim"] for r in with_similarity(pairs, "a", "b").collect()}
    assert got["ZENITH FOODS", "ZENITH FOOD"] > 0.85 and got["ZENITH FOODS", "MARINE WORKS"] < 0.5 and got["A", "A"] == 1.0


def test_narration(spark):
    text = "NEFT CR HDFC0001234 7000000000000123 FROM ZENITH FOODS INV-2026-000123"
    assert one(spark, text, S.extract_utr) == "7000000000000123"
    assert one(spark, text, S.invoice_tokens) == ["INV-2026-000123"]
    assert "ZENITH" in one(spark, text, S.counterparty_hint)
    assert one(spark, "MONTHLY MAINTENANCE CHG", S.purpose_tags) == ["CHARGE"]


def test_business_days(spark):
    d = spark.createDataFrame([(date(2026, 9, 5),)], "d date")  # a Saturday
    assert d.select(S.add_business_days("d", 1).alias("x")).first()["x"] == date(2026, 9, 7)
    assert d.select(F.bround(S.quarter_end_boost("d"), 2).alias("x")).first()["x"] == 1.0
