"""Streaming of the relational engine."""
