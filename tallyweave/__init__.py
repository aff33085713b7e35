"""Tallyweave: production-record reconciliation on Spark DataFrames."""
