"""Readers and writers of the network tables."""
