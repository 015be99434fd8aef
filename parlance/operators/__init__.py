"""Operators over conversation data."""
