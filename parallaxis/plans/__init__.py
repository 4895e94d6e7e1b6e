"""Whole pipelines as single lazy plans."""
