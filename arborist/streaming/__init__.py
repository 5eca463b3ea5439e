"""Structured Streaming over run records; an extension, the batch operators don't need it."""
