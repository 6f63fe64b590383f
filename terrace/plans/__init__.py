"""Composing operators: configured flows and their templates."""
