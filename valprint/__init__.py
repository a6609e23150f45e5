"""Value-set fingerprinting and column recognition on Spark."""
