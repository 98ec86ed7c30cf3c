"""Operators over vector tables."""
