"""tidewell plans."""
