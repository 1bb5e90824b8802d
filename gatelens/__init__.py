"""Gate and identity event analytics, and training-data operators, as PySpark jobs over tables."""
