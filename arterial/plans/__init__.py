"""Whole computations: the derived network, the registry of queries and their SQL."""
