"""Readers that turn tables and text files into graph DataFrames."""
