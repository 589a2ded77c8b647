"""Retrieval and knowledge analytics expressed as Spark DataFrame operators."""
