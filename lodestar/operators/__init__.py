"""Joins, graph walks, ranking, aggregation and reports over fact tables."""
