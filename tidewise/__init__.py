"""tidewise: local item search, menu extraction and corpus preparation as Spark jobs."""
