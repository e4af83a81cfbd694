"""recallgrid: Spark-first analytics over agent memory (events, facts, vectors, graph, state)."""
