"""Brindle: document retrieval and training-data operators as Spark DataFrame plans."""
