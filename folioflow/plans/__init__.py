"""Whole queries and pipelines."""
