"""Operators on entity tables and version histories."""
