"""Automated machine learning on tables, written as Spark jobs."""
