"""Registered queries, their bindings to tables and their SQL."""
