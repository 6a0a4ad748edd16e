"""Catalog, frames and the assembly of panels."""
