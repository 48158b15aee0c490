"""Operators of the lodestone engine."""
