"""Training-data operators: scoring, near-duplicate search, sharding, mixing and tokenising.

Nothing else in the library imports this subpackage; it stands on PySpark alone.
"""
