"""Structured Streaming jobs: every micro-batch runs the batch operators plus the state of the last one."""
