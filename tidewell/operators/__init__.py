"""tidewell operators."""
