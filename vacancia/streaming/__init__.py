"""Stateful work over file streams."""
