"""Functions of the relational engine."""
