"""Queries with their SQL."""
