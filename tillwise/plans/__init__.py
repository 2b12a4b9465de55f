"""Whole queries composed from the operators, and their SQL twins."""
