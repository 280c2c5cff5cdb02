"""Auditing what arrives as a stream."""
