"""Composed views and the registered query catalogue."""
