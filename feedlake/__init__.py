"""feedlake: multi-source feed ingestion and data-quality toolkit on PySpark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, so Catalyst can prune, push filters and pick join strategies.
"""

__version__ = "0.1.0"
