"""Operators on tables of cells, contracts and findings."""
