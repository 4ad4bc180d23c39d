"""Watershed delineation and corpus analytics as Spark jobs."""
