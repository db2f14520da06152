"""Lakesearch: crawl, index and search analytics as PySpark DataFrame plans."""
