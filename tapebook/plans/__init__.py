"""Tapes from given tables, queries over them, and their SQL."""
