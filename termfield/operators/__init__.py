"""Operators on term models and long tables (target, feature, value)."""
