"""Incremental maintenance of fact tables."""
