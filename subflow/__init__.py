"""Quality-gated ingestion of delimited subscription files on PySpark."""
