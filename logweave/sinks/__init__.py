"""Where records, packs and segments are written to."""
