"""Fluorite: spot analytics for fluorescence microscopy, and corpus operators, as PySpark DataFrame functions."""
