"""topicspark: research-corpus analytics as PySpark DataFrame operators."""
