"""Spatio-temporal network operations analytics as PySpark DataFrame operators."""
