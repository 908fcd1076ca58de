"""Reading session files and writing session tables."""
