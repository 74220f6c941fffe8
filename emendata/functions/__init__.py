"""Scalar functions: expressions where they exist, Arrow functions where code must be parsed."""
