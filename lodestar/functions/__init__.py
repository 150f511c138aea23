"""Part of lodestar."""
