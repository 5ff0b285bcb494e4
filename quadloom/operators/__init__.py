"""Operators over DataFrames: intervals, skewed aggregation, change feeds, pivoting, graph scans and joins."""
