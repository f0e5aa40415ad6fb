"""Structure-aware document retrieval, evaluation and corpus preparation on Spark."""
