"""Windowed profiles of event streams."""
