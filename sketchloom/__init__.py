"""Sketch-based set layout analytics on Spark."""
