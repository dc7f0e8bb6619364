"""Plans: the registered queries (Spark side) and their independent SQL oracle."""
