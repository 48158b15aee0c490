"""Streaming of the lodestone engine."""
