"""Operators: every one takes a lazy DataFrame and a configuration and returns a DataFrame."""
