"""Spatial barcode analytics and training-data operators on Spark."""
