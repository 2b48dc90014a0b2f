"""Spark-first engine for labelled message -> record data."""
