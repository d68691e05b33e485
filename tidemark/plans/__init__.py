"""Plans of the relational engine."""
