"""Models behind one fit and predict contract."""
