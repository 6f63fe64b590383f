"""Incremental versions of the batch writes."""
