"""Business-registry, financial-statement and research-project integration on Spark."""
