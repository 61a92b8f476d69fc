"""Functions of the core engine."""
