"""Readers and projections that yield fact tables."""
