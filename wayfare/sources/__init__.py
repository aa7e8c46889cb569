"""Readers, writers and the project catalogue."""
