"""Queries that run every operator over the star-schema tables, with the SQL that gives the same rows."""
