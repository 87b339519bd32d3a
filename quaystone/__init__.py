"""Quaystone: a Spark-first engine for archives of channel posts.

Search, links, integrity, incremental ingestion and the data-preparation operators
are DataFrame functions; nothing here collects a table to the driver.
"""

__version__ = "0.1.0"
