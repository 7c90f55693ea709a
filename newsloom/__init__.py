"""Curation and analytics of news metadata as PySpark DataFrame jobs."""
