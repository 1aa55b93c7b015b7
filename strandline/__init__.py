"""Panel, event-stream and path analytics as Spark DataFrame jobs."""
