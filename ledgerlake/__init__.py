"""Booking and payment lakehouse operators for PySpark.

Every operator takes DataFrames and returns a DataFrame; publishing, version
pinning and streaming are thin shells in ``sources``, ``streaming`` and ``plans``.
"""

__version__ = "0.1.0"
