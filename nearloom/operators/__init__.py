"""Nearest-neighbour operators, exact and approximate."""
