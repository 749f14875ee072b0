"""Training-data operators (sharding, dedup, classification, packing, ...).

Nothing else in the library imports this subpackage; the queries and their SQL
are in ``registry``.
"""
