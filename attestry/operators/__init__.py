"""Operators: functions from DataFrames to DataFrames. Where order matters, rows have an explicit `ord`."""
