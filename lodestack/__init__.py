"""Part of the lodestack engine."""
