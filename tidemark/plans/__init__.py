"""Composed queries: 1-A, 1-B (rentals and weather), 2-A, 2-B (oil and station
prices), their building blocks as standalone queries, and the registry."""
