"""Measure how decisions drift when the stream they are based on is perturbed, as Spark jobs."""
