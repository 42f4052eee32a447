"""Readers, writers and the adapters that give the canonical frames."""
