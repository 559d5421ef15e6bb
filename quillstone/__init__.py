"""Filings analytics as Spark DataFrame jobs, plus a subpackage of corpus operators."""
