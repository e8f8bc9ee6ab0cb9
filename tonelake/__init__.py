"""Audio-stream and media analytics on PySpark."""
