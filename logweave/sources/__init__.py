"""Where logs, topics and segments are read from."""
