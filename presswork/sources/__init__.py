"""Inputs: Parquet tables, the JSON roster, JSON wire requests."""
