"""Regime analytics of paired time series on Spark."""
