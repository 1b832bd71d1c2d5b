"""Contact-list cleaning, matching and readiness scoring on Apache Spark."""
