"""Accessibility analytics on Spark DataFrames: points, road edges, cost tables, coverage, selection."""
