"""Operators over runs: merge, reads, blocks, filters, cache, cursor."""
