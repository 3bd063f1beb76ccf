"""Structured Streaming entry points (scoring of arriving orders)."""
