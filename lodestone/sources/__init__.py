"""Sources of the lodestone engine."""
