"""Operators over long tables."""
