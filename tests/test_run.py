import json

from pyspark.sql import functions as F

from ledgerspark.plans.run import run_books, write_all
from ledgerspark.sources import reports

BANK = """txn_date,narration,utr,amount_in,amount_out
2026-09-03,NEFT CR FROM ZENITH FOODS INV-2026-000001,u1,100.00,
2026-09-04,MONTHLY MAINTENANCE CHG,,,9.00
2026-09-04,ZERO,,,
"""
INVOICES = """invoice_no,customer_name,customer_code,invoice_date,due_date,gross_amount
INV-2026-000001,ZENITH FOODS,C1,2026-08-15,2026-09-01,100.00
INV-2026-000002,OPTIC STORES,C2,2026-08-15,2026-08-20,123456.78
"""


def test_run_writes_all_reports(spark, tmp_path):
    books, out = tmp_path / "books", tmp_path / "out"
    books.mkdir()
    (books / "bank_statement.csv").write_text(BANK)
    (books / "invoices.csv").write_text(INVOICES)
    (books / "opening_balance.csv").write_text("as_of,balance\n2026-09-05,10\n")
    write_all(spark, run_books(spark, str(books)), str(out))
    manifest = json.loads((out / "run_manifest.json").read_text())
    assert (manifest["lines"], manifest["documents"], manifest["matches_by_tier"], manifest["unresolved"]) == (2, 2, {"t3": 1}, 1)
    matches = (out / "matches.csv").read_text().splitlines()
    assert len(matches) == 2 and ",1,t3,0," in matches[1] and matches[1].endswith(",yes")
    assert "BANK_CHARGE_NO_DOCUMENT" in (out / "exceptions.csv").read_text()
    assert "zero amount" in (out / "parse_failures.csv").read_text()
    assert (out / "settlements.csv").read_text() == "no_rows\n"
    assert "₹1,23,456.78" in (out / "report.md").read_text() and "<table>" in (out / "dashboard.html").read_text()


def test_md_table(spark):
    df = spark.range(40).select(F.lit("a|b\nc").alias("x"), F.lit("y" * 99).alias("y"))
    lines = reports.md_table(df).splitlines()
    assert len(lines) == 27 and lines[2] == f"| a/b c | {'y' * 70} |"
    assert reports.md_table(df.limit(0)) == "_no rows_\n"


def test_sparkline():
    assert reports.sparkline([1]) == "" and 'points="0.0,40.0 240.0,0.0"' in reports.sparkline([0, 5])
