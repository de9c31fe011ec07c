"""Nearest-neighbour analytics on Spark."""

version = "0.2.0"
