"""Whole pipelines and registered queries."""
