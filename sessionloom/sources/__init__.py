"""Readers of the stored tables and of text files."""
