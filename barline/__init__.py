"""Daily-bar and news analytics as PySpark DataFrame operators."""
