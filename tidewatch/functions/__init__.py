"""Scalar column expressions (JVM side)."""
