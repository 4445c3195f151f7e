"""Quern: variant enumeration, sequence scoring and selection as Spark DataFrame operations."""
