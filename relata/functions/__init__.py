"""functions of the relational context engine."""
