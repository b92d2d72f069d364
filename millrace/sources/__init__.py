"""Readers and writers of training data, behind a registry of names."""
