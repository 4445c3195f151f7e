"""Quern sources."""
