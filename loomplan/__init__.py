"""Seasonal assortment and order planning, and training-data preparation, on Spark."""
