"""Spark-native retail, risk, time-series and text analytics.

Transforms take and return DataFrames, do no I/O and own no session, so batch
and streaming jobs share them.
"""
