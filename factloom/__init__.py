"""Corpus, lineage and code-fact analytics expressed as Spark DataFrame jobs."""
