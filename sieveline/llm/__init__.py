"""Training-data operators: extraction, quality, dedup, toxicity, sharding, tokens.

Nothing else in the library imports this subpackage.
"""
