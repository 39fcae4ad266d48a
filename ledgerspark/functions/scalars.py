"""Column functions: money, dates and narration text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import RULES

# Legal suffixes, narration filler words, folding table, channel and purpose keywords.
LEGAL = "PVT PRIVATE LTD LIMITED LLP INC CO COMPANY CORP CORPORATION INDIA THE".split()
FILLER = "NEFT IMPS UPI RTGS SAX CIB HDFC00 SBIN00 ICIC00 KKBK00 UTIB000 PAYMENT REC RECEIPT SALE INV INVOICE BILL TAX REF TRANSACTION COLLECTION DR CR VAL DIFF FROM TO FOR INR".split()
ACCENTS = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
CHANNELS = [
    ("NEFT", ["NEFT", "CIB", "SAX"]),
    ("IMPS", ["IMPS"]),
    ("UPI", ["UPI", "@YBL", "@OKAXIS", "@AXL"]),
    ("RTGS", ["RTGS"]),
    ("CHEQUE", ["CHQ", "CHEQUE"]),
    ("GATEWAY_SETTLEMENT", ["RZP", "RAZORPAY", "SETL_"]),
    ("INTEREST", ["INT"]),
    ("BANK_CHARGE", ["CHG", "FEE", "COMMISSION", "AMC"]),
    ("REVERSAL", ["REVERS", "CANCEL", "REFUND"]),
]
PURPOSES = [
    ("CHARGE", ["FEE", "CHG", "CHARGES", "MAINTAIN", "AMC", "PROCESSING"]),
    ("INTEREST", ["INTEREST", "INT CR", "BANNER"]),
    ("REVERSAL", ["REVERS", "CANCEL", "RETURN", "REFUND", "DEBIT ADJ"]),
    ("GATEWAY", ["RAZORPAY", "GATEWAY SETTLEMENT", "SETL_"]),
    ("SALARY", ["SALARY", "PAYROLL"]),
    ("STATUTORY", ["GST", "TDS", "INCOME TAX", "TAX PAYMENT"]),
]
HINT_STRIP = [
    r"\b[A-Z]{2,6}[-/]?\d{4}[-/]?\d{3,8}\b",
    r"\b(?:INV|RT|VB|PO|BILL|SALARY|RENT|EMI|GST)-[A-Z0-9\-]+\b",
    r"\bSETL_\w+\b",
    r"\b(?:NEFT|RTGS|IMPS|UPI|CHQ|CLG|SAX|CIB|SBIN|HDFC|ICIC|KKBK|UTIB|AXIS)\b[\w./-]*",
    r"\b(?:FROM|TO|CR|DR|REF|VAL|INR|RS\.?|₹)\b",
    r"\b[A-Z0-9._\-]{2,64}@(?:YBL|OK[A-Z]+|AXL|AIRTEL|HDFCBANK|ICICI|PAYTM|SBI)\b",
    r"\b\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?\b",
    r"\b\d{6,}\b",
    r"\b(?:MONTHLY|MAINTAINANCE|MAINTENANCE|PROCESSING|FEE|CHG|CHARGES|AMC|INTEREST|SETTLEMENT|GATEWAY|PAYMENT|TRANSACTION|BALANCE|QUARTERLY|REVERSAL|CANCELLED|REFUND|INVALID|SIGNATURE|RETURN)\b",
]
UTR_LABELLED, UTR_BARE = r"(?i)\b(?:UTR|NUTR|SICN|CIBN|UTI|OTH)\s*[:\-]?\s*(\d{12,17})\b", r"\b(\d{16,17})\b"
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "dMMMyy", "yyyy/M/d"]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """Trimmed, with blank as null."""
    return F.nullif(F.trim(col(x)), F.lit(""))


def paise(raw: Column | str) -> Column:
    """Rupee text to paise, half up; brackets or a leading minus are negative; what is no number is null."""
    t = F.trim(col(raw))
    inside = F.regexp_extract(t, r"^\((.*)\)$", 1)
    bracket = t.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.when(bracket, inside).otherwise(t), r"(?i)[₹INR\s,]", "")
    value = F.when(bare.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), F.round(bare.try_cast("decimal(38,6)") * 100, 0).try_cast("bigint"))
    return F.when(bracket, -value).otherwise(value)


def paise_or_zero(raw: Column | str) -> Column:
    return F.coalesce(paise(raw), F.lit(0).cast("long"))


def rupees(p: Column | str) -> Column:
    return (col(p) / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")


def fmt_inr(p: Column | str) -> Column:
    """₹ with lakh and crore grouping and two decimals; null is '-'."""
    a = F.abs(col(p))
    whole = F.floor(a / 100).cast("string")
    head, tail = F.expr("''"), whole
    head = F.when(F.length(whole) > 3, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise("")
    tail = F.when(F.length(whole) > 3, F.concat(F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    grouped = F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), tail)
    return F.when(col(p).isNull(), "-").otherwise(F.concat(F.when(col(p) < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0")))


def parse_date(raw: Column | str) -> Column:
    """The first of the known formats that fits the text, then its part before a T or a blank, then d/m/yy."""
    t = F.trim(col(raw))
    head = F.split(t, "[T ]").getItem(0)
    short = F.regexp_replace(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$", "20$3-$2-$1")
    tries = [F.try_to_date(x, f) for x in (t, head) for f in DATE_FORMATS] + [F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}$"), F.try_to_date(short, "yyyy-M-d")), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")]
    return F.coalesce(*tries)


def strip_accents(x: Column | str) -> Column:
    return F.translate(col(x), *ACCENTS)


def norm_name(x: Column | str, keep_suffixes: bool = False) -> Column:
    t = F.regexp_replace(F.upper(strip_accents(F.coalesce(col(x), F.lit("")))), r"""[!-/:-@\[-`{-~]""", " ")
    parts = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d{4,}$") & (F.lit(keep_suffixes) | ~w.isin(LEGAL)))
    return F.array_join(parts, " ")


def name_tokens(norm: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(col(norm), " "), lambda w: ~w.isin(FILLER) & (F.length(w) > 1)))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """0.85 of the common share of the smaller set and 0.15 of the Jaccard share."""
    n = F.size(F.array_intersect(a, b)).cast("double")
    score = 0.85 * n / F.least(F.size(a), F.size(b)) + 0.15 * n / F.size(F.array_union(a, b))
    return F.when(n > 0, score).otherwise(0.0)


def extract_utr(x: Column | str) -> Column:
    pick = lambda p: F.nullif(F.regexp_extract(col(x), p, 1), F.lit(""))
    return F.coalesce(pick(UTR_LABELLED), pick(UTR_BARE))


def upi_handle(x: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(x), r"\b[\w.\-]{2,64}@[\w]{2,64}\b", 0)), F.lit(""))


def gateway_refs(x: Column | str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(r"\b((?:pay|order|setl|fund|sign|token)_[0-9a-zA-Z]{8,})\b"), F.lit(1))


def amount_hint(x: Column | str) -> Column:
    return paise(F.nullif(F.regexp_extract(col(x), r"(?i)(?:rs\.?|inr|₹)\s*([0-9,]+(?:\.[0-9]{1,2})?)", 1), F.lit("")))


def _has(text: Column, needles: list) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def narration_kind(x: Column | str) -> Column:
    t = F.upper(F.coalesce(col(x), F.lit("")))
    return F.coalesce(*[F.when(_has(t, needles), F.lit(kind)) for kind, needles in CHANNELS], F.lit("OTHER"))


def purpose_tags(x: Column | str) -> Column:
    t = F.upper(F.coalesce(col(x), F.lit("")))
    return F.array_compact(F.array(*[F.when(_has(t, needles), F.lit(tag)) for tag, needles in PURPOSES]))


def invoice_tokens(x: Column | str, patterns: list | None = None) -> Column:
    """Document numbers in the text and in its letters and digits alone, first mention first."""
    t = F.upper(F.coalesce(col(x), F.lit("")))
    sources = [t, F.regexp_replace(t, "[^A-Z0-9]", "")]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(0)) for p in patterns or RULES["invoice_number_patterns"] for s in sources]))


def doc_key(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(x), F.lit(""))), "[^A-Z0-9]", "")


def counterparty_hint(x: Column | str) -> Column:
    t = F.upper(strip_accents(F.coalesce(col(x), F.lit(""))))
    for p in HINT_STRIP:
        t = F.regexp_replace(t, p, " ")
    return F.array_join(F.filter(F.split(norm_name(t), " "), lambda w: ~w.isin(FILLER) & ~w.rlike(r"^\d+$") & (F.length(w) > 1)), " ")


def aging_recovery(days: Column | str, table: list | None = None) -> Column:
    """Share of an overdue claim that is expected back."""
    steps = table or RULES["aging_recovery"]
    return F.coalesce(*[F.when(col(days) >= d, F.lit(r)) for d, r in steps], F.lit(1.0))


def tolerance(amount: Column | str, rules: dict = RULES) -> Column:
    r = rules["amount_tolerance"]
    return F.greatest(F.lit(r["rounding_paise"]).cast("long"), F.least((F.abs(col(amount)) * F.lit(r["pct_of_invoice"])).cast("long"), F.lit(r["absolute_max_paise"]).cast("long")))


def in_window(txn: str, due: str, doc: str, tier: str, rules: dict = RULES) -> Column:
    """Paid near the due date, or not too long after the document's date."""
    (early, late), floor = rules["date_windows_days"][tier], rules["date_windows_days"]["floor"]
    rel = F.datediff(col(txn), col(due))
    return rel.between(-early, late) | ((rel > late) & (F.datediff(col(txn), col(doc)) <= floor + late + early))


def add_business_days(d: Column | str, n: int) -> Column:
    """The n-th day after d that is no Sunday; d itself for n = 0."""
    days = F.filter(F.sequence(F.date_add(col(d), 1), F.date_add(col(d), n + n // 6 + 2)), lambda x: F.weekday(x) != 6)
    return col(d) if n == 0 else F.element_at(days, n)


def quarter_end_boost(d: Column | str) -> Column:
    return F.when(F.month(col(d)).isin(3, 6, 9, 12) & (F.dayofmonth(col(d)) >= 25), 1.15).otherwise(1.0)
