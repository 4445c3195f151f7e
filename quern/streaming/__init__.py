"""Quern streaming."""
