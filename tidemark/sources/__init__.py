"""Sources of the relational engine."""
