"""Spark jobs over particle trajectories seen in microscopy movies."""
