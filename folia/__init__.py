"""Citation search, content analytics and corpus preparation as Spark jobs."""
