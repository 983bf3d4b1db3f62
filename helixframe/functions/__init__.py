"""Part of helixframe."""
