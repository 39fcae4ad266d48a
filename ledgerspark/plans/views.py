"""Books derived from the star-schema tables, as common table expressions that Spark and DuckDB both run.

Only spelling differs between the two: list indexing, day differences and
integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Amber Birch Cedar Delta Ember Falcon Garnet Harbor Indigo Jasper Kestrel Lotus".split()
SECOND = "Foods Textiles Motors Pharma Steel Paper Optics Marine Agro Energy Plastics Tools".split()
THIRD = "Traders Exports Works Mills Supply Ventures Partners Stores Systems Brothers Group".split()
AS_OF = "2000-06-30"
TABLES = "region nation customer supplier part orders lineitem events".split()


def pick(words: list, i: str, spark: bool) -> str:
    """The i-th word (from 0)."""
    items = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({items}), cast({i} as int) + 1)" if spark else f"[{items}][{i} + 1]"


def div(a: str, b: int, spark: bool) -> str:
    return f"(({a}) div {b})" if spark else f"(({a}) // {b})"


def days(end: str, start: str, spark: bool) -> str:
    return f"datediff({end}, {start})" if spark else f"CAST(datediff('day', {start}, {end}) AS INTEGER)"


def party(k: str, spark: bool) -> str:
    return f"{pick(FIRST, f'({k} % 12)', spark)} || ' ' || {pick(SECOND, f'({div(k, 12, spark)} % 12)', spark)} || ' ' || {pick(THIRD, f'({div(k, 144, spark)} % 11)', spark)} || ' Pvt Ltd'"


def ctes(spark: bool) -> dict[str, str]:
    d = lambda a, b: div(a, b, spark)
    day = lambda c: f"CAST({c} AS DATE)"
    plus = lambda c, n: f"date_add({c}, cast({n} as int))" if spark else f"({c} + CAST({n} AS INTEGER))"
    cents = lambda c: f"CAST(round({c} * 100) AS BIGINT)"
    text = "STRING" if spark else "VARCHAR"
    s = lambda c: f"CAST({c} AS {text})"
    method = "CASE l_linenumber % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'upi_qr' WHEN 2 THEN 'netbanking' ELSE 'wallet' END"
    utr = "'7' || lpad({}, 15, '0')"
    return {
        "ar_docs": f"""SELECT o_orderkey AS seq, 'AR-' || {s("o_orderkey")} AS doc_id, 'AR' AS kind, 'INV-' || {s("year(o_orderdate)")} || '-' || lpad({s("o_orderkey")}, 6, '0') AS number,
            {party("o_custkey", spark)} AS counterparty, 'CUST-' || {s("o_custkey")} AS party_code, {cents("o_totalprice")} AS amount, CAST(0 AS BIGINT) AS paid,
            {day("o_orderdate")} AS doc_date, {plus(day("o_orderdate"), "(o_custkey % 4) * 15")} AS due_date, o_orderkey AS k, o_orderstatus AS st FROM orders""",
        "ap_lines": f"""SELECT l_orderkey AS ok, l_suppkey AS sk, sum({cents("l_extendedprice")}) AS amount, min({day("l_shipdate")}) AS shipped FROM lineitem GROUP BY l_orderkey, l_suppkey""",
        "ap_docs": f"""SELECT CAST(1000000000000 AS BIGINT) + ok * 1000 + sk AS seq, 'AP-' || {s("ok")} || '-' || {s("sk")} AS doc_id, 'AP' AS kind, 'VB-' || {s("year(shipped)")} || '-' || lpad({s("ok % 1000000")}, 6, '0') AS number,
            {party("sk", spark)} AS counterparty, 'VEND-' || {s("sk")} AS party_code, CAST(amount AS BIGINT) AS amount, CAST(0 AS BIGINT) AS paid, shipped AS doc_date, {plus("shipped", "30")} AS due_date, ok AS k, 'F' AS st FROM ap_lines""",
        "docs": "SELECT seq, doc_id, kind, number, counterparty, party_code, amount, paid, doc_date, due_date FROM ar_docs UNION ALL SELECT seq, doc_id, kind, number, counterparty, party_code, amount, paid, doc_date, due_date FROM ap_docs",
        "payments": f"""SELECT 'pay_' || {s("l_orderkey")} || '_' || {s("l_linenumber")} AS payment_id, CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE 'setl_' || {s(plus(day("l_shipdate"), "2"))} END AS settlement_id,
            {cents("l_extendedprice")} AS amount, {method} AS method, {day("l_shipdate")} AS captured_on FROM lineitem""",
        "refunds": f"""SELECT 'rf_' || {s("l_orderkey")} || '_' || {s("l_linenumber")} AS refund_id, CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE 'setl_' || {s(plus(day("l_shipdate"), "2"))} END AS settlement_id,
            {d(cents("l_extendedprice") + " * 3", 1000)} AS amount, {plus(day("l_shipdate"), "2")} AS created_on FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""",
        "batch_sums": f"""SELECT settlement_id, {plus("max(captured_on)", "2")} AS settled_on, count(*) AS txn_count, CAST(sum(amount) AS BIGINT) AS gross,
            CAST(sum(CASE method WHEN 'upi_qr' THEN 0 WHEN 'netbanking' THEN {d("amount * 9", 1000)} ELSE {d("amount", 50)} END) AS BIGINT) AS fee0 FROM payments WHERE settlement_id IS NOT NULL GROUP BY settlement_id""",
        "batch_refunds": "SELECT settlement_id AS rid, CAST(sum(amount) AS BIGINT) AS refunded FROM refunds WHERE settlement_id IS NOT NULL GROUP BY settlement_id",
        "batch_terms": f"""SELECT settlement_id, settled_on, txn_count, gross, CASE WHEN day(settled_on) = 13 THEN fee0 + {d("gross", 400)} ELSE fee0 END AS fee, {d("gross", 100000)} AS tmn,
            coalesce(refunded, 0) AS refunded FROM batch_sums LEFT JOIN batch_refunds ON settlement_id = rid""",
        "batch_taxes": f"SELECT *, {d('(fee + tmn) * 18', 100)} AS gst, {d('fee', 50)} AS tds FROM batch_terms",
        "settlements": f"""SELECT CAST({days("settled_on", "DATE '1990-01-01'", spark)} AS BIGINT) AS seq, settlement_id, settled_on, '8' || lpad({s(days("settled_on", "DATE '1990-01-01'", spark))}, 15, '0') AS payout_utr, txn_count, gross, fee, tmn, gst, tds,
            gross - fee - tmn - gst - tds - refunded - CASE WHEN day(settled_on) = 17 THEN {d("gross", 500)} ELSE 0 END AS net FROM batch_taxes""",
        "ar_lines": f"""SELECT k * 10 AS seq, 'BL-' || {s("k")} AS line_id, {plus("due_date", "k % 23 - 6")} AS txn_date,
            amount - CASE WHEN k % 17 = 0 THEN {d("amount * 2", 100)} ELSE 0 END AS amount, CASE WHEN k % 10 = 9 THEN NULL ELSE {utr.format(s("k"))} END AS utr,
            CASE WHEN k % 10 < 5 THEN 'NEFT CR HDFC0001234 ' || {utr.format(s("k"))} || ' FROM ' || upper(counterparty) || ' ' || number
                 WHEN k % 10 < 7 THEN 'RTGS SBIN0004321 ' || {utr.format(s("k"))} || ' ' || counterparty || ' INR'
                 WHEN k % 10 < 9 THEN 'UPI/ICIC/' || {utr.format(s("k"))} || '/payer@okaxis/' || counterparty ELSE 'CHQ CLG ' || counterparty END AS narration,
            k, doc_id FROM ar_docs WHERE st IN ('F', 'O') AND k % 11 <> 0""",
        "ap_paid": f"""SELECT CAST(500000000000 AS BIGINT) + seq AS seq, 'BD-' || doc_id AS line_id, {plus("due_date", "k % 15 - 4")} AS txn_date, -amount AS amount, CAST(NULL AS {text}) AS utr,
            CASE WHEN k % 2 = 0 THEN 'NEFT DR TO ' || counterparty || ' ' || number ELSE 'IMPS DR ' || counterparty END AS narration, k, doc_id FROM ap_docs WHERE k % 3 = 0""",
        "bank_lines": f"""SELECT seq, line_id, txn_date, amount, utr, narration FROM ar_lines
            UNION ALL SELECT seq + 1, line_id || '-D', {plus("txn_date", "1")}, amount, utr, narration FROM ar_lines WHERE k % 50 = 3 OR k % 70 = 9
            UNION ALL SELECT seq, line_id, txn_date, amount, utr, narration FROM ap_paid
            UNION ALL SELECT CAST(2000000000000 AS BIGINT) + seq, 'BS-' || settlement_id, settled_on, net - CASE WHEN day(settled_on) = 19 THEN 5000 ELSE 0 END, CASE WHEN seq % 3 = 0 THEN NULL ELSE payout_utr END, 'RAZORPAY PAYMENTS GATEWAY SETTLEMENT ' || settlement_id FROM settlements WHERE day(settled_on) <> 23
            UNION ALL SELECT CAST(3000000000000 AS BIGINT) + event_id, 'BC-' || {s("event_id")}, CAST(ts AS DATE), -(1000 + event_id % 500), CAST(NULL AS {text}),
              CASE event_id % 3 WHEN 0 THEN 'MONTHLY MAINTENANCE CHG' WHEN 1 THEN 'CREDIT INTEREST CAPITALISED' ELSE 'NACH RETURN REVERSAL' END FROM events WHERE event_id % 97 = 0""",
        "advices": f"""SELECT k AS seq, 'ADV-' || {s("k")} AS advice_id, counterparty AS payer_name, amount, due_date AS notified_on, CASE WHEN k % 4 < 3 THEN number ELSE NULL END AS invoice_no, {utr.format(s("k"))} AS utr FROM ar_docs WHERE k % 9 = 0""",
        "cleared": "SELECT doc_id, min(txn_date) AS cleared_on FROM (SELECT doc_id, txn_date FROM ar_lines UNION ALL SELECT doc_id, txn_date FROM ap_paid) AS u GROUP BY doc_id",
        "links": "SELECT settlement_id, 'BS-' || settlement_id AS line_id FROM settlements WHERE day(settled_on) <> 23",
        "truth": "SELECT line_id, doc_id, CASE WHEN k % 17 = 0 THEN 'matchable_amount_mismatch' ELSE 'matchable' END AS kind, amount FROM ar_lines UNION ALL SELECT line_id, doc_id, 'matchable', amount FROM ap_paid",
    }


def needs(name: str, found: dict[str, str], into: list[str]) -> list[str]:
    """``name`` and the expressions that it reads, in the order in which they must stand."""
    for other in found:
        if other != name and other not in into and f" {other} " in f" {found[name]} ".replace("\n", " ").replace(")", " ").replace("(", " "):
            needs(other, found, into)
    if name not in into:
        into.append(name)
    return into


def prefix(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    found, order = ctes(False), []
    for n in names:
        needs(n, found, order)
    return "WITH " + ",\n".join(f"{n} AS ({found[n]})" for n in order)


class Views:
    """The views as Spark frames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.found = spark, sf_dir, ctes(True)

    def __call__(self, name: str) -> DataFrame:
        order = needs(name, self.found, [])
        tables = {t: self.spark.read.parquet(f"{self.dir}/{t}.parquet") for t in TABLES if any(f" {t} " in f" {self.found[n]} ".replace("\n", " ") for n in order)}
        body = ",\n".join(f"{n} AS ({self.found[n]})" for n in order)
        heads = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in tables)
        return self.spark.sql(f"WITH {heads}, {body} SELECT * FROM {name}", **tables)
