"""tidewell sources."""
