"""operators of the relational context engine."""
