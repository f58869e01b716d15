"""Spark jobs for large panels of weekly series: history, forecasts, backtests, decisions."""
