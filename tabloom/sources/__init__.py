"""Readers, writers and append-only result tables."""
