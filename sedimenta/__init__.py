"""sedimenta: document ingestion, chunking, change tracking and retrieval evaluation on Spark."""

__version__ = "0.1.0"
