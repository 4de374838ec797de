"""Batch and streaming Spark jobs for funding-opportunity catalogs."""
