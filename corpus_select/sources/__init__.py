"""Readers, writers, registry and materialised intermediates."""
