"""Learning analytics over game event logs and run scores, as Spark jobs."""
