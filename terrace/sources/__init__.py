"""Reading raw data, and reading and writing lakehouse tables."""
