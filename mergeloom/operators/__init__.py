"""Relational operators of the merge engine."""
