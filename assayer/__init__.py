"""Selective-evaluation analytics on Spark."""
