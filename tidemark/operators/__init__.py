"""Operators of the relational engine."""
