"""Operators for preparing training data, each usable on any table with a text or vector column."""
