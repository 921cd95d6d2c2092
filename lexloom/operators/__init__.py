"""Relational operators over the lexical graph."""
