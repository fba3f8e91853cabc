"""Labour-market analytics as DataFrame functions on Spark."""
