"""Statements as DataFrame operations."""
