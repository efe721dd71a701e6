"""Screening of daily price bars, Spark first."""
