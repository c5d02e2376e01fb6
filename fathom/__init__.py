"""Spark-first engine for sonar surveys, tracks and time series."""
