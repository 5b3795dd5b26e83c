"""streaming of the relational context engine."""
