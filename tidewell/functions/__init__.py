"""tidewell functions."""
