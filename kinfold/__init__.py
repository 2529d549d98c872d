"""kinfold: similarity search, retrieval evaluation and training-data
preparation over labelled protein sequences, on the Spark DataFrame API."""

__version__ = "0.1.0"
