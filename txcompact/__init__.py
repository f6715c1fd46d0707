"""Compaction and savings analytics over corpora of assistant transcripts, on Spark."""
