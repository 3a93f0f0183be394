"""Trajectory analytics on Spark: designs, simulations, timelines, features, clusters and their reports."""
