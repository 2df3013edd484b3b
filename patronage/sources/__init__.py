"""Readers, writers and header mapping."""
