"""Ordered byte-key analytics on Spark."""

ABI_VERSION = 1
