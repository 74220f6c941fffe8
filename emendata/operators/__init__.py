"""Relational operators on tables of problems, answers and verdicts."""
