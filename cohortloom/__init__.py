"""Longitudinal panels from filing tables, as lazy Spark plans."""
