"""Versioned text-corpus analytics on Spark."""
