"""Training-data operators: mixing, packing, tokenised output, dedup, search and scoring.

Nothing else in the library imports this subpackage.
"""
