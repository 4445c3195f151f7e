"""Quern operators."""
