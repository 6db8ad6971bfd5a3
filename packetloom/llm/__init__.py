"""Operators for large text corpora, their queries and the SQL twins; nothing else in the library imports this."""
