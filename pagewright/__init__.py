"""Corpus ingestion, scoped hybrid retrieval and answer checking as Spark jobs."""
