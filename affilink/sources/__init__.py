"""Readers and writers of registries and reports."""
