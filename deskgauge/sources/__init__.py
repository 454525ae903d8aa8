"""Readers with contracts, and sinks."""
