"""Tuning text and runtime settings."""
