"""Customer analytics over retail invoice lines, written as Spark DataFrame jobs."""
