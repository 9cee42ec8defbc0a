"""Temporal-network analytics on Spark."""
