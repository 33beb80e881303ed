"""Registered queries: landing views over the given tables, Spark jobs and their SQL checks."""
