"""Structured Streaming forms of flow assembly and clumping."""
