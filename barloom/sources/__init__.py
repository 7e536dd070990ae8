"""Readers, writers and message schemas."""
