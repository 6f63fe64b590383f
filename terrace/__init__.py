"""Medallion-style data preparation and analytics as lazy Spark DataFrame operators."""
