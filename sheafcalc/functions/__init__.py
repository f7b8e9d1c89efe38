"""Worksheet functions as Spark columns: scalars, criteria, aggregates and lookups."""
