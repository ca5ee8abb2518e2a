"""Column functions on texts and time codes."""
