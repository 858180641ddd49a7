"""Gaussian processes on nearest-neighbour graphs, as Spark jobs."""
