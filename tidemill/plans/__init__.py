"""Queries composed from the operators, each with its SQL where SQL can express it."""
