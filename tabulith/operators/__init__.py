"""Operators: functions from DataFrames to DataFrames whose heavy work runs in Spark."""
