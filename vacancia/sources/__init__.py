"""Readers that turn landed data into canonical tables."""
