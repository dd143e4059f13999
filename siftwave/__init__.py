"""siftwave: message-risk analytics as PySpark jobs."""
