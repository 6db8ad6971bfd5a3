"""Longer jobs built from the operators."""
