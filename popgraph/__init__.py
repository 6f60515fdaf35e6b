"""Population-graph analytics and two-stage recommendation as Spark DataFrame jobs."""
