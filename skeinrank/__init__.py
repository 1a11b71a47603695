"""skeinrank: ranked full-text retrieval and corpus processing as Spark query plans."""
