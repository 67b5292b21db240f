"""Signal, audio and corpus analytics written as Spark jobs."""
