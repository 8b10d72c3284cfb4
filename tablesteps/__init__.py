"""Old table steps, reconciliation, profiling and program-corpus analytics as Spark jobs."""
