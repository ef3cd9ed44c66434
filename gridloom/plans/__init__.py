"""Query plans: the registry of queries with their SQL, and what sessions need to run them."""
