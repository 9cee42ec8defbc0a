"""Logical building blocks: the network, its supports, and measurement grids."""
