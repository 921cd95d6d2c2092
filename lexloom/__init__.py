"""Lexical-graph analytics and training-data operators expressed as Spark jobs."""
