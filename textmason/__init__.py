"""Analytics and migration of versioned text corpora, as Spark DataFrame operators."""
