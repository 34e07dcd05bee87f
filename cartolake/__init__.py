"""Spatial city-data analytics and text-corpus preparation as PySpark jobs."""
