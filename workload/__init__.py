"""The registered queries: views over the given tables, Spark queries, matching SQL."""
