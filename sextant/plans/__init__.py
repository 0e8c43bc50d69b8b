"""Registered queries and the alignment study."""
