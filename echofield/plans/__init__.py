"""Contracts, presets, recipes, and the queries over the test tables."""
