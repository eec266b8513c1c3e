"""Schemas of the bronze, silver and gold tables."""

from __future__ import annotations

RAW_FILES = "id BIGINT, sha256 STRING, filename STRING, source STRING, status STRING, error STRING, rows_total BIGINT, rows_new BIGINT, holder STRING, uploaded_at TIMESTAMP"
TRANSACTIONS = (
    "id BIGINT, value_date DATE, booking_date DATE, description STRING, amount DECIMAL(18,4), currency STRING, account STRING, source STRING, category STRING, natural_key STRING, "
    "file_id BIGINT, created_at TIMESTAMP, native_category STRING, category_confidence FLOAT, category_source STRING, mcc STRING, transfer_group STRING, merchant STRING, purchase_time STRING"
)
ACCOUNTS = "account_id STRING, source STRING, bank_name STRING, product STRING, holding_modality STRING, currency STRING, iban STRING, display_name_override STRING"
TRADES = "natural_key STRING, side STRING, isin STRING, instrument STRING, asset_class STRING, quantity DECIMAL(28,10), unit_price DECIMAL(20,10)"
BALANCES = "account STRING, balance_date DATE, balance DECIMAL(14,2), currency STRING, source STRING, basis STRING"
TRAINING_LABELS = "id BIGINT, text_norm STRING, category STRING, source STRING, confidence FLOAT"
FEEDBACK = "id BIGINT, natural_key STRING, category STRING, corrected_by STRING, created_at TIMESTAMP"

STATUSES = ("pending", "parsed", "failed")
CATEGORY_SOURCES = ("mcc", "model", "rule", "manual", "default")
SIDES = ("buy", "sell")
BASES = ("value", "booking")
