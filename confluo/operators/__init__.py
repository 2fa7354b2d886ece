"""Operators: functions from DataFrames to DataFrames (lazy unless noted)."""
