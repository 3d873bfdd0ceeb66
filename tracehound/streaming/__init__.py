"""Structured Streaming jobs. The transforms are those of the batch operators wherever they are stateless."""
