"""Operators: functions from DataFrames to DataFrames. The time is always an argument."""
