"""Structured-document search, retrieval evaluation and data preparation as Spark DataFrame operators."""
