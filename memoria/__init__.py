"""A conversation and knowledge memory on Spark: retrieval under a scope ceiling, facts over time, graph, roll-ups, evaluation."""
