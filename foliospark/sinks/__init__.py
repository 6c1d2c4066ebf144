"""Keyed, re-runnable writers."""
