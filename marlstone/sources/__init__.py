"""Readers, writers and archives."""
