"""Program-fact analytics on Spark: relational queries, graph walks, fixpoints and merges over fact tables."""
