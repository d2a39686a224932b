"""Operators on tables that grow."""
