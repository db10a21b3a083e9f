"""Readers and writers of tables, headers, name lists, configurations and models."""
