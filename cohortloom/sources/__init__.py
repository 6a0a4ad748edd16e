"""Readers of table-years and of the organization dimension."""
