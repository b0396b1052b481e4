"""Registered queries over the shared tables, grouped by theme."""
