"""Registered queries with their SQL, and whole pipelines."""
