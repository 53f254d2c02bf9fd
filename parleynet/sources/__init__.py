"""Readers, writers and collectors' row logic. Fetching pages over a network is not part of the engine."""
