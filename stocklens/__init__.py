"""Catalog and site-quality analytics as Spark jobs."""
