"""Operators: functions from DataFrames to DataFrames or to small fitted values."""
