"""Sinks: CSV, JSON, Markdown and HTML reports of a run.

Tables of any size are written by the executors; ``single_csv`` moves the one
part of a small table to a plain file. Only the rows that a Markdown or HTML
table shows come to the driver.
"""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fmt_inr

TABLE_ROWS, CELL_CHARS = 25, 70


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file on any file system that Spark knows."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, for tables of any size."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; an empty table gives the line ``no_rows``."""
    spark = df.sparkSession
    if df.isEmpty():
        write_text(spark, path, "no_rows\n")
        return
    folder = f"{path}.{uuid.uuid4().hex}"
    write_csv(df.coalesce(1), folder)
    fs, p = _fs(spark, path)
    fs.delete(p, False)
    part = next(s.getPath() for s in fs.globStatus(_fs(spark, f"{folder}/part-*")[1]))
    fs.rename(part, p)
    fs.delete(_fs(spark, folder)[1], True)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str) + "\n")


def matches_table(matches: DataFrame) -> DataFrame:
    """One line a match, least certain first; documents joined by semicolons."""
    rows = matches.select("line_id", F.array_join("doc_ids", ";").alias("doc_ids"), F.size("doc_ids").alias("n_docs"), "tier", "diff", "confidence", F.when(F.col("auto_post"), "yes").otherwise("no").alias("auto_post"))
    return rows.orderBy("confidence", "tier", "line_id")


def exceptions_table(exceptions: DataFrame, lines: DataFrame) -> DataFrame:
    """Triaged exceptions with their bank lines; the narration is cut to 160 characters."""
    own = lines.select("line_id", "txn_date", F.substring("narration", 1, 160).alias("narration"))
    return exceptions.join(own, "line_id", "left").select("line_id", "txn_date", "amount", "code", "category", "action", "owner", "narration").orderBy("code", "line_id")


def aged_table(aged: DataFrame) -> DataFrame:
    """Open receivables, largest first, with the amount as rupees."""
    return aged.withColumn("outstanding_inr", fmt_inr("outstanding")).orderBy(F.desc("outstanding"), "doc_id")


def cell(c: Column) -> Column:
    """A value as table text: one line, bars escaped, at most ``CELL_CHARS`` characters."""
    return F.substring(F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("/")), 1, CELL_CHARS)


def _shown(df: DataFrame, limit: int) -> list[list[str]]:
    return [list(r) for r in df.limit(limit).select([cell(F.col(f"`{c}`")).alias(c) for c in df.columns]).collect()]


def md_table(df: DataFrame, limit: int = TABLE_ROWS) -> str:
    """The first rows as a Markdown table; ``_no rows_`` if there are none."""
    rows = _shown(df, limit)
    if not rows:
        return "_no rows_\n"
    line = lambda cells: "| " + " | ".join(cells) + " |\n"
    return line(df.columns) + line(["---"] * len(df.columns)) + "".join(line(r) for r in rows)


def html_table(df: DataFrame, limit: int = TABLE_ROWS) -> str:
    rows = _shown(df, limit)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def sparkline(values: list[float], width: int = 240, height: int = 40) -> str:
    """An SVG line through the values; nothing for fewer than two."""
    if len(values) < 2:
        return ""
    low, span = min(values), (max(values) - min(values)) or 1
    points = " ".join(f"{i * width / (len(values) - 1):.1f},{height - (v - low) * height / span:.1f}" for i, v in enumerate(values))
    return f'<svg width="{width}" height="{height}" viewBox="0 0 {width} {height}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def page(title: str, parts: list[tuple[str, str]]) -> str:
    """An HTML page of headed sections."""
    body = "".join(f"<section><h2>{html.escape(h)}</h2>{b}</section>" for h, b in parts)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>\n'
