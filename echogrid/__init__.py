"""Wireless-sensing analytics as plain Spark DataFrame transformations."""
