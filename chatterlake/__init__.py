"""Market and chatter analytics as Spark jobs."""
