"""Structured Streaming around the maintenance operators."""
