"""Quarrylight: document-corpus analytics written as Spark DataFrame, SQL and streaming plans."""
