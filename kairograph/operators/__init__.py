"""Operators: network and parameters in, tidy DataFrame out."""
