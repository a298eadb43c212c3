"""signalwatch: surveillance analytics over text, telemetry and graphs as Spark jobs."""
