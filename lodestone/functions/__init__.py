"""Functions of the lodestone engine."""
