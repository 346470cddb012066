"""Spark-native ledger of LLM usage: turns, commits, footprint, and reports over them."""
