"""Queries over the local star schema, by area, each with the SQL that checks it."""
