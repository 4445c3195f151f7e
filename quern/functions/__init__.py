"""Quern functions."""
