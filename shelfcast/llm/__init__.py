"""Training-data operators: search, fingerprints, dedup, filters, archives, mixing, tokenising.

Nothing outside this subpackage imports it; ``catalog`` holds its driver queries.
"""
