"""groundlake: a Spark-first engine for satellite telemetry and pass planning."""
