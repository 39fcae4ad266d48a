"""A whole book: load, reconcile, verify, triage, write the reports."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, recon, verify
from ..settings import RULES
from ..sources import reports
from ..sources.books import Books, load_books
from .ladder import reconcile


@dataclass
class RunResult:
    books: Books
    matches: DataFrame
    unresolved: DataFrame
    exceptions: DataFrame
    claims: DataFrame
    aged: DataFrame
    stage_ms: dict[str, float]


def run_books(spark: SparkSession, folder: str, rules: dict = RULES, strategy: str = "full") -> RunResult:
    """Reconciles the books of a folder and recomputes its gateway batches."""
    took, began = {}, time.time()

    def lap(stage: str) -> None:
        nonlocal began
        took[stage], began = round((time.time() - began) * 1000, 2), time.time()

    books = load_books(spark, folder)
    as_of = F.lit(books.as_of).cast("date")
    lap("ingest")
    matches, unresolved = reconcile(books.bank_lines, books.docs, books.advices, books.settlements, rules, strategy)
    lap("reconcile")
    links = matches.where("tier = 't1'").select(F.expr("substring(doc_ids[0], 6)").alias("settlement_id"), "line_id")
    expected = verify.batch_expected(books.settlements, books.payments, books.refunds, rules["fees"])
    flagged = verify.batch_flags(verify.with_credits(expected, links, books.bank_lines), as_of, rules["fees"])
    claims = verify.batch_claims(flagged, rules["fees"])
    exceptions = evaluate.triage(recon.classify_unresolved(unresolved).withColumn("ref_type", F.lit("bank_line")))
    aged = evaluate.aged_receivables(books.docs, as_of)
    lap("verify")
    return RunResult(books, matches, unresolved, exceptions, claims, aged, took)


def _plain(df: DataFrame) -> DataFrame:
    """Arrays as text, as CSV has no arrays."""
    return df.select([F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_all(spark: SparkSession, result: RunResult, out: str) -> dict:
    """CSV tables, Markdown, HTML and the manifest; returns the manifest."""
    tables = {
        "matches": reports.matches_table(result.matches),
        "exceptions": reports.exceptions_table(result.exceptions, result.books.bank_lines),
        "settlements": _plain(result.claims),
        "aged_receivables": reports.aged_table(result.aged),
        "parse_failures": _plain(result.books.quarantine),
    }
    for name, df in tables.items():
        reports.single_csv(df, f"{out}/{name}.csv")
    by_tier = result.matches.groupBy("tier").agg(F.count("*").alias("matches"), F.count_if("auto_post").alias("auto_posted")).orderBy("tier")
    mix = evaluate.exception_mix(result.exceptions).orderBy(F.desc("n"), "code")
    counts = {r["tier"]: r["matches"] for r in by_tier.collect()}
    manifest = {"as_of": result.books.as_of, "lines": result.books.bank_lines.count(), "documents": result.books.docs.count(), "matches_by_tier": counts, "unresolved": result.unresolved.count(), "warnings": result.books.warnings, "stage_ms": result.stage_ms}
    reports.write_json(spark, f"{out}/run_manifest.json", manifest)
    heads = [("Matches by tier", by_tier), ("Exceptions", mix), ("Receivables", tables["aged_receivables"])]
    reports.write_text(spark, f"{out}/report.md", "# Reconciliation\n\n" + "\n".join(f"## {h}\n\n{reports.md_table(df)}" for h, df in heads))
    reports.write_text(spark, f"{out}/dashboard.html", reports.page("Reconciliation", [(h, reports.html_table(df)) for h, df in heads]))
    return manifest
