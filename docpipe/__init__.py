"""docpipe: Spark jobs over document collections, in batch and as streams."""
