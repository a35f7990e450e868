"""Registries (S1, S2) and readers/writers."""
