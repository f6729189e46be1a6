"""tesserae: document retrieval, table analytics and corpus maintenance on Spark DataFrames."""

__version__ = "0.1.0"
