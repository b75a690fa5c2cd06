"""Spreadsheet audit and ledger reconciliation over whole corpora, on Spark."""
