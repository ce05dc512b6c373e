"""Retail point-of-sale analytics as plain PySpark DataFrame functions."""
