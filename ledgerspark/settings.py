"""Rules and rate card: fixed defaults, overridable from JSON files."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path

# Tolerances, windows (days early, late against the due date), confidences, policy and fees.
RULES = {
    "invoice_number_patterns": [r"\b(?:INV|SINV|SALES|RT|PO|BILL|VB|SUP)[-/]?\d{4}(?:[-/]?\d{1,6})?\b"],
    "name_similarity": {"auto_post_min": 0.86, "review_min": 0.70},
    "amount_tolerance": {"rounding_paise": 100, "pct_of_invoice": 0.005, "absolute_max_paise": 500_000},
    "date_windows_days": {"utr": [60, 90], "doc_number": [45, 150], "amount_exact": [20, 25], "amount_plus_name": [25, 40], "fuzzy": [30, 60], "lumpsum": [30, 60], "floor": 20},
    "lumpsum": {"max_candidates": 12, "min_parts": 2, "max_parts": 6, "residual_candidates": 14, "residual_parts": 4},
    "duplicate_days": 3,
    "base_confidence": {"t1": 0.985, "t2": 0.965, "t3": 0.955, "t4": 0.925, "t5": 0.860, "t6": 0.830, "t7": 0.700, "t8": 0.620},
    "auto_post": {"min_confidence": 0.90, "max_amount_paise": 2_000_000_000},
    "strategies": {"exact": ["t1", "t2", "t3"], "fuzzy_only": ["t4", "t5", "t6", "t7"], "full": ["t1", "t2", "t3", "t4", "t5", "t6", "t7"]},
    "cash_policy": {"minimum_cash_paise": 300_000_000, "horizons": [7, 14, 30], "runs": 2000},
    "aged_daily_hazard": 0.012,
    "aging_recovery": [[181, 0.02], [91, 0.10], [61, 0.28], [31, 0.55]],
    "fees": {"modes": {"card": 0.02, "upi_qr": 0.0, "upi_apps": 0.02, "netbanking": 0.009, "wallet": 0.02, "emi": 0.02}, "default_mode": "card", "gst": 0.18, "tds": 0.02, "tmn": 0.00001, "tolerance_paise": 200, "expect_days": 2, "gap_days": 4},
}


def merged(base: dict, extra: dict) -> dict:
    """``extra`` over ``base``, dictionaries key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in extra.items()}


def load_rules(path: str | None = None) -> dict:
    """The defaults, under the overrides of a JSON file; a missing or invalid file leaves the defaults."""
    rules = deepcopy(RULES)
    if not path:
        return rules
    try:
        return merged(rules, json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError):
        return rules
