"""Readers and writers. Each reader is a thin scan plus a transform that also works on a frame in hand."""
