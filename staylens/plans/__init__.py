"""End-to-end builds, and the query registry over the test tables."""
