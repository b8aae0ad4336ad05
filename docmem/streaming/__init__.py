"""Edits and messages as streams."""
