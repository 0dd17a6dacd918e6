"""Weftline: a Spark-first engine that orders and orients sequence fragments from link evidence."""
