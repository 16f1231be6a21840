"""quillon: a Postgres-flavoured relational engine that runs on Spark."""
