"""Agent-trajectory analytics as Spark jobs."""
