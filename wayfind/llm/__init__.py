"""Training-data operators: filtering, deduplication, decontamination, tokens.

Self-contained: nothing else in the library imports this subpackage.
"""
