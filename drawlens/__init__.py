"""Draw-history analytics as Spark jobs: sources, operators, functions, plans and streaming."""
