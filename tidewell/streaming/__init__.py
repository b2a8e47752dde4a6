"""tidewell streaming."""
