"""Compilers from parsed filters and expressions to Spark columns."""
