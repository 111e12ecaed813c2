"""Bars, features, signals, outcomes and research tables on Spark."""
