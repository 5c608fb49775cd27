"""Ledgerwright: an invoice ledger engine on Spark, with operators for training data in ``ledgerwright.llm``."""
