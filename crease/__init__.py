"""crease: ball-by-ball event analytics as Spark DataFrame jobs."""
