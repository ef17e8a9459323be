"""Training-data operators: PII, near and exact duplicates, archives, contamination, quality, mixing, toxicity, repeats, secrets.

Nothing else in the library imports this subpackage.
"""
