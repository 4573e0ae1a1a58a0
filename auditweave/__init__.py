"""Audit-log investigation on Spark."""
