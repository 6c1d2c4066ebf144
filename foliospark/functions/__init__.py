"""Column helpers. Everything here is a Catalyst expression; nothing crosses into Python."""
