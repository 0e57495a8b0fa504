"""Sensor analytics on PySpark: align, smooth, window, split, compare."""
