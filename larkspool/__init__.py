"""Speech-transcript data flow and corpus preparation as Spark jobs."""
