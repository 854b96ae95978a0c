"""listwright: listing intelligence as Spark jobs."""
