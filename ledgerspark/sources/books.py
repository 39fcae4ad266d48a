"""CSV books: typed frames, and a quarantine frame of the rows that were refused."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import doc_key, extract_utr, filled, paise, paise_or_zero, parse_date

QUARANTINE = "file string, row long, reason string, raw string"


@dataclass
class Books:
    bank_lines: DataFrame
    docs: DataFrame
    advices: DataFrame
    settlements: DataFrame
    payments: DataFrame
    refunds: DataFrame
    quarantine: DataFrame
    opening_paise: int
    as_of: object
    warnings: list


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blanks as null, and ``row``, the record's number in its file (2 for the first)."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.select([filled(f"`{c}`").alias(c.strip().lstrip("﻿")) for c in df.columns])
    # one file is one partition here, as records may span lines; ids within it follow the file
    return df.withColumn("row", F.monotonically_increasing_id() + 2)


def first(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is filled; missing columns count as blank."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))


def split_bad(df: DataFrame, path: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the quarantine rows of the others."""
    name = os.path.basename(path)
    raw = F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")]))
    df = df.withColumn("_reason", reason)
    return df.where("_reason is null").drop("_reason"), df.where("_reason is not null").select(F.lit(name).alias("file"), F.col("row"), F.col("_reason").alias("reason"), raw.alias("raw"))


def bank_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    stem = os.path.splitext(os.path.basename(path))[0]
    amount = paise_or_zero(first(df, "amount_in", "credit")) - paise_or_zero(first(df, "amount_out", "debit"))
    df = df.withColumns({"_amount": amount, "_date": parse_date(first(df, "txn_date", "date"))})
    good, bad = split_bad(df, path, F.when(F.col("_amount") == 0, "zero amount").when(F.col("_date").isNull(), "bad date"))
    text = F.coalesce(first(df, "narration", "description"), F.lit(""))
    return good.select(
        F.col("row").alias("seq"), F.coalesce(first(df, "line_id"), F.concat(F.lit(stem + "-"), F.col("row"))).alias("line_id"), F.col("_date").alias("txn_date"), text.alias("narration"),
        F.col("_amount").alias("amount"), F.coalesce(first(df, "utr"), extract_utr(text)).alias("utr"), F.coalesce(first(df, "account"), F.lit("PRIMARY")).alias("account"),
    ), bad


def documents(spark: SparkSession, path: str, kind: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    net = first(df, "net_amount")
    gross = paise_or_zero(first(df, "gross_amount", "amount"))
    df = df.withColumns({"_n": first(df, "document_no", "invoice_no", "bill_no"), "_d": parse_date(first(df, "document_date", "invoice_date", "bill_date")), "_g": gross})
    good, bad = split_bad(df, path, F.when(F.col("_n").isNull() | F.col("_d").isNull() | (F.col("_g") <= 0), "missing number/date/amount"))
    amount = F.coalesce(F.nullif(F.when(net.isNull(), F.col("_g")).otherwise(paise_or_zero(net)), F.lit(0).cast("long")), F.col("_g"))
    return good.select(
        (F.col("row") + offset).alias("seq"), F.coalesce(first(df, "document_id"), F.concat(F.lit(kind + "-"), doc_key(F.col("_n")))).alias("doc_id"), F.lit(kind).alias("kind"), F.col("_n").alias("number"),
        F.coalesce(first(df, "counterparty", "customer_name", "vendor_name"), F.lit("")).alias("counterparty"), F.coalesce(first(df, "counterparty_code", "customer_code", "vendor_code"), F.lit("")).alias("party_code"),
        amount.alias("amount"), paise_or_zero(first(df, "paid_amount")).alias("paid"), F.col("_d").alias("doc_date"), F.coalesce(parse_date(first(df, "due_date")), F.col("_d")).alias("due_date"),
        F.coalesce(first(df, "status"), F.lit("open")).alias("status"),
    ), bad


def advices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    df = df.withColumns({"_a": paise_or_zero(first(df, "amount")), "_d": parse_date(first(df, "notified_on", "notified_date"))})
    good, bad = split_bad(df, path, F.when((F.col("_a") <= 0) | F.col("_d").isNull(), "bad advice"))
    return good.select(F.col("row").alias("seq"), first(df, "advice_id").alias("advice_id"), first(df, "payer_name").alias("payer_name"), F.col("_a").alias("amount"), F.col("_d").alias("notified_on"), first(df, "invoice_no").alias("invoice_no"), F.coalesce(first(df, "utr"), extract_utr(first(df, "narration_hint"))).alias("utr")), bad


def settlements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    df = df.withColumn("_d", parse_date(first(df, "settled_on", "created_at")))
    good, bad = split_bad(df, path, F.when(F.col("_d").isNull(), "bad settlement date"))
    money = {"gross": "gross_amount", "fee": "commission_amount", "tmn": "tmn_amount", "gst": "gst_amount", "tds": "tds_amount", "net": "net_amount"}
    return good.select(F.col("row").alias("seq"), first(df, "settlement_id").alias("settlement_id"), F.col("_d").alias("settled_on"), first(df, "payout_utr").alias("payout_utr"), first(df, "batch_type").alias("batch_type"), first(df, "txn_count").try_cast("double").cast("int").alias("txn_count"), *[paise_or_zero(first(df, c)).alias(n) for n, c in money.items()]), bad


def payments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    df = df.withColumn("_d", parse_date(first(df, "captured_at", "created_at")))
    good, bad = split_bad(df, path, F.when(F.col("_d").isNull(), "bad payment date"))
    return good.select(F.col("row").alias("seq"), first(df, "payment_id").alias("payment_id"), first(df, "settlement_id").alias("settlement_id"), paise_or_zero(first(df, "amount")).alias("amount"), first(df, "method").alias("method"), F.col("_d").alias("captured_on"), paise(first(df, "fee")).alias("fee"), first(df, "status").alias("status"), first(df, "notes_invoice_no").alias("invoice_no")), bad


def refunds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = read_csv(spark, path)
    df = df.withColumn("_d", parse_date(first(df, "created_at", "refund_date")))
    good, bad = split_bad(df, path, F.when(F.col("_d").isNull(), "bad refund date"))
    return good.select(F.col("row").alias("seq"), first(df, "refund_id").alias("refund_id"), first(df, "payment_id").alias("payment_id"), first(df, "settlement_id").alias("settlement_id"), paise_or_zero(first(df, "amount")).alias("amount"), F.col("_d").alias("created_on")), bad


READERS = {"bank_statement.csv": bank_lines, "payment_advices.csv": advices, "razorpay_settlements.csv": settlements, "razorpay_payments.csv": payments, "razorpay_refunds.csv": refunds}
EMPTY = {
    "payment_advices.csv": "seq long, advice_id string, payer_name string, amount long, notified_on date, invoice_no string, utr string",
    "razorpay_settlements.csv": "seq long, settlement_id string, settled_on date, payout_utr string, batch_type string, txn_count int, gross long, fee long, tmn long, gst long, tds long, net long",
    "razorpay_payments.csv": "seq long, payment_id string, settlement_id string, amount long, method string, captured_on date, fee long, status string, invoice_no string",
    "razorpay_refunds.csv": "seq long, refund_id string, payment_id string, settlement_id string, amount long, created_on date",
}
DOCS = "seq long, doc_id string, kind string, number string, counterparty string, party_code string, amount long, paid long, doc_date date, due_date date, status string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_books(spark: SparkSession, folder: str) -> Books:
    """All files of a book; only the bank statement must exist, others leave a warning and an empty frame."""
    found, bad, warnings = {}, spark.createDataFrame([], QUARANTINE), []
    for name, reader in READERS.items():
        path = f"{folder}/{name}"
        if exists(spark, path):
            found[name], q = reader(spark, path)
            bad = bad.unionByName(q)
        elif name in EMPTY:
            found[name] = spark.createDataFrame([], EMPTY[name])
            warnings.append(f"missing {name}")
        else:
            raise FileNotFoundError(path)
    docs = spark.createDataFrame([], DOCS)
    for name, kind, offset in (("invoices.csv", "AR", 0), ("bills.csv", "AP", 1 << 40)):
        if exists(spark, f"{folder}/{name}"):
            d, q = documents(spark, f"{folder}/{name}", kind, offset)
            docs, bad = docs.unionByName(d), bad.unionByName(q)
        else:
            warnings.append(f"missing {name}")
    opening, as_of = 0, None
    if exists(spark, f"{folder}/opening_balance.csv"):
        df = read_csv(spark, f"{folder}/opening_balance.csv")
        if r := df.select(paise_or_zero(first(df, "balance", "opening_balance", "amount")).alias("b"), parse_date(first(df, "as_of", "date")).alias("d")).first():
            opening, as_of = r["b"], r["d"]
    lines = found["bank_statement.csv"]
    as_of = as_of or lines.agg(F.max("txn_date")).first()[0]
    return Books(lines, docs, found["payment_advices.csv"], found["razorpay_settlements.csv"], found["razorpay_payments.csv"], found["razorpay_refunds.csv"], bad, opening, as_of, warnings)
